"""Settings, texts and names that results depend on."""

# --- fixed values -----------------------------------------------------------
WORDS_PER_ANALYSIS = 200
WORDS_PER_ROLLING_SUMMARY = 300
SUMMARY_WORD_BUDGET = 1000
COMPREHENSIVE_TAIL_WORDS = 800
FINAL_TAIL_WORDS = 1000
RECENT_SEGMENTS = 3
SUMMARY_SEGMENTS = 5
RETRY_SEGMENTS = 10
PROMPT_ISSUES = 5
HISTORY_ITEMS = 10
MIN_WORDS_ON_DEMAND = 10

MANUAL_THRESHOLD = 999999
PRESET_THRESHOLDS = (200, 300, 500, 1000)
CUSTOM_THRESHOLD_RANGE = (50, 5000, 50)  # min, max, step

TEMPERATURE = 0.3
MAX_TOKENS = {"incremental": 1500, "comprehensive": 2000, "final": 2500, "summary": 200}
PRICE_PER_1K_TOKENS = 0.0002

TEXT_FIELD = "technical_analysis"
HISTORY_FIELDS = ("potential_issues", "recommendations")
OPEN_FIELDS = ("clarifying_questions", "action_items")
LIST_FIELDS = HISTORY_FIELDS + OPEN_FIELDS

LIVE_DEFAULT_TEXT = "No technical discussion detected yet"
FINAL_DEFAULT_TEXT = "No technical analysis available"
ERROR_PREFIX = "Error: "
BAD_JSON = "Invalid JSON from API"
NO_TRANSCRIPT = "No transcript to analyze yet"

EMPTY_SECTION_TEXT = {
    "potential_issues": "No issues detected in current discussion",
    "recommendations": "(No recommendations yet)",
    "clarifying_questions": "(No questions)",
    "action_items": "(No action items identified)",
}
LEGACY_DEFAULT_TEXT = {
    "summary": "No summary",
    "action_items": "(none yet)",
    "it_insights": "(none yet)",
    "key_decisions": "(none yet)",
}

EVENT_ROUTES = {
    "input_audio_buffer.speech_started": "speech_started",
    "input_audio_buffer.committed": "committed",
    "conversation.item.input_audio_transcription.completed": "completed",
    "input_audio_buffer.speech_stopped": "speech_stopped",
    "error": "error",
}

SAMPLE_RATE = 16000
CHUNK_SAMPLES = 32000
OVERLAP_SAMPLES = 24000
FLUSH_SAMPLES = 16000

VOICE_SCORE = 0.5
VOICE_SILENCE_MS = 700
VOICE_PREFIX_MS = 300
# ----------------------------------------------------------------------------
