"""Deterministic detection of technical problems, domains and tasks in text.

The rules stand in for a model where none can be reached. Rules are few and
fixed, so each is a column expression: nothing is joined and no text moves.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from colloquy.functions.text import n_words, words
from colloquy.operators.blocks import each


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    issue: str
    recommendation: str = ""
    question: str = ""


# --- fixed values: the default rules ------------------------------------------
RULES = (
    Rule("jump_box_subnet",
         r"(?i)(jump ?box|bastion)[^.]*(separate|different|another|other) (subnet|network|vnet)",
         "The jump box sits in another subnet than the cluster, which can break connectivity.",
         "Place the jump box in the cluster's network and isolate it with network security rules.",
         "Is the jump box meant to be a bastion host?"),
    Rule("open_remote_access",
         r"(?i)(port 22|ssh|rdp|port 3389)[^.]*(any ip|anywhere|0\.0\.0\.0/0|all addresses)",
         "Remote access open to any address invites brute-force attacks.",
         "Restrict remote access to known address ranges or use a managed session service.",
         "Which addresses need remote access?"),
    Rule("plain_credentials",
         r"(?i)(hard-?cod\w*[^.]*(credential|password|secret|key)|(credential|password|secret)s?[^.]*hard-?cod|password will be)",
         "Credentials are written into code or configuration.",
         "Keep credentials in a secret store and rotate them.",
         "Where will secrets be stored?"),
    Rule("single_zone",
         r"(?i)(same|single|one) (availability )?zone",
         "All nodes share one availability zone, a single point of failure.",
         "Spread the nodes over several availability zones.",
         "What availability does the service need?"),
    Rule("undersized_server",
         r"(?i)\b(t2|t3|t3a|t4g)\.(nano|micro)\b",
         "The instance is too small for a build server.",
         "Choose an instance with enough memory for the builds.",
         "How many builds run at once?"),
    Rule("late_logging",
         r"(?i)(logging|monitoring|backups?)[^.]*(later|at some point|eventually)",
         "Logging, monitoring or backup is put off.",
         "Set it up before going live.",
         "Who will own it?"),
)

DOMAINS = {
    "cloud": ("azure", "aws", "gcp", "ec2", "s3", "vm", "cloud"),
    "containers": ("kubernetes", "aks", "eks", "gke", "docker", "pod", "cluster", "node", "nodes"),
    "networking": ("subnet", "vnet", "vpc", "dns", "firewall", "peering", "port", "ip", "network"),
    "devops": ("jenkins", "pipeline", "deploy", "deployment", "terraform", "ansible", "build"),
    "security": ("credentials", "password", "ssh", "tls", "encryption", "compliance", "security", "access"),
    "architecture": ("microservices", "service", "api", "queue", "event", "cache", "latency"),
    "database": ("database", "mongodb", "postgres", "mysql", "sql", "schema", "index", "replica"),
    "administration": ("patch", "backup", "logging", "monitoring", "server", "user", "users"),
}

OWNER = r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)"
DUE = r"(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day|tomorrow|tonight|end of (?:day|week|month)"
OPENING = rf"^{OWNER} (?:will|should|is going to) "
TASK = rf"{OPENING}(.+?)(?: (?:by|before|until) ({DUE}))?$"
NOT_OWNERS = ("It", "This", "That", "These", "Those", "There", "The", "You", "He", "She", "They", "We", "What", "Who")
# ------------------------------------------------------------------------------


def matches(text, rules=RULES) -> Column:
    """The ids of the rules that apply to a text, in rule order."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_compact(F.array(*[F.when(text.rlike(r.pattern), F.lit(r.rule_id)) for r in rules]))


def messages(ids, attribute, rules=RULES) -> Column:
    """What the rules with these ids have to say: issue, recommendation or question."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    said = [F.when(F.array_contains(ids, r.rule_id), F.lit(getattr(r, attribute))) for r in rules if getattr(r, attribute)]
    return F.array_compact(F.array(*said)) if said else F.array().cast("array<string>")


def rule_analysis(text, rules=RULES) -> Column:
    """An analysis of a text, in the response schema; every pattern runs once."""
    text = F.col(text) if isinstance(text, str) else text
    # A one-element transform names what was found, so that it is not worked out again.
    found = F.array(F.struct(matches(text, rules).alias("ids"), task_list(text).alias("tasks")))

    def describe(f):
        def said(attribute):
            return messages(f["ids"], attribute, rules)

        tasks = F.transform(f["tasks"], lambda t: F.concat(
            t["owner"], F.lit(": "), t["task"], F.when(t["due"] != "", F.concat(F.lit(" (due "), t["due"], F.lit(")"))).otherwise("")))
        overview = F.format_string("%d words, %d problems found", n_words(text), F.size(f["ids"]))
        return F.struct(overview.alias("technical_analysis"), said("issue").alias("potential_issues"),
                        said("recommendation").alias("recommendations"), said("question").alias("clarifying_questions"),
                        tasks.alias("action_items"))

    return F.element_at(F.transform(found, describe), 1)


def rule_scorer(rules=RULES):
    """A scorer (requests -> responses) that needs no model."""
    def score(requests: DataFrame) -> DataFrame:
        text = F.col("user_prompt")
        # A summary names what was found in all of the text.
        found = F.array(rule_analysis(text, rules))
        summary = F.element_at(F.transform(found, lambda a: F.concat_ws(
            "; ", a["technical_analysis"], a["potential_issues"], a["action_items"])), 1)
        answer = F.when(F.col("json_mode"), F.to_json(rule_analysis(text, rules))).when(F.col("json_mode").isNotNull(), summary)
        unknown = F.when(F.col("json_mode").isNull(), F.concat(F.lit("unknown kind of request: "), "kind"))
        scored = requests.select("request_id", "meeting_id", "fire_no", "kind", answer.alias("response"),
                                 unknown.alias("error"),
                                 (n_words("system_prompt") + n_words("user_prompt")).cast("int").alias("prompt_tokens"))
        counted = scored.withColumn("completion_tokens", n_words("response").cast("int"))
        return counted.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))

    score.reads_history = False
    return score


def sentences(text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    parts = F.transform(F.split(text, r"[.!?]+(?:\s+|$)|\n+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def task_list(text) -> Column:
    """``owner, task, due`` of every sentence that assigns a task; due may be empty."""
    def parse(s):
        return F.struct(F.regexp_extract(s, TASK, 1).alias("owner"), F.regexp_extract(s, TASK, 2).alias("task"),
                        F.regexp_extract(s, TASK, 3).alias("due"))

    found = F.transform(F.filter(sentences(text), lambda s: s.rlike(OPENING)), parse)
    return F.filter(found, lambda t: (t["owner"] != "") & ~t["owner"].isin(*NOT_OWNERS))


def tasks(segments: DataFrame, by=("meeting_id", "seq")) -> DataFrame:
    rows = each(segments, "_t", task_list("text"))
    return rows.select(*by, "_t.owner", "_t.task", F.nullif("_t.due", F.lit("")).alias("due"))


def domain_counts(segments: DataFrame, by=("meeting_id",), domains=None) -> DataFrame:
    """How often each meeting uses the words of a domain."""
    domains = DOMAINS if domains is None else domains
    spark = segments.sparkSession
    schema = T.StructType([T.StructField("domain", T.StringType()), T.StructField("word", T.StringType())])
    terms = spark.createDataFrame([(d, w) for d, ws in domains.items() for w in ws], schema)
    said = each(segments, "_w", words(F.lower("text")))
    said = said.select(*by, F.regexp_replace("_w", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("word"))
    # The term list is a handful of fixed rows.
    return said.join(F.broadcast(terms), "word").groupBy(*by, "domain").agg(F.count("*").alias("mentions"))
