"""Main text of web pages by a tree-structured graphical model over their elements.

A page becomes a tree of its block elements. Each has a hidden label, content
or not, with a potential from its tag, its class and id words and how much of
its text is links, and a potential for each pair of parent and child. Messages
passed from the leaves up and from the root down (sum-product) give the exact
probability of each label; the text of elements above one half is the page's
main text. The weights are learnt by gradient ascent on the likelihood of
labelled pages, for which the same messages give the expected counts.
"""

import html
import math
import random
import re

from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import ship, slices

PAGES = 200                 # labelled pages that a model is fitted on, at most
PAGE_CHARS = 20_000         # longer pages are no examples
VARIANTS, EPOCHS = 10, 10    # rewritten forms of each labelled page, passes over all

# Element names by the role the HTML standard gives them.
BLOCK = frozenset("html body article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead "
                  "tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset details summary address hr center dialog".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style title textarea noscript template iframe svg math select button object audio video canvas head".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
_NAMES = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PART = re.compile(r"[a-z]+")
_WORDS = re.compile(r"[a-z]+|[A-Z]+[a-z]*")


class Node:
    __slots__ = ("tag", "names", "parent", "kids", "runs", "chars", "linked", "stops", "label")

    def __init__(self, tag, names, parent, label=None):
        self.tag, self.names, self.parent, self.kids, self.label = tag, names, parent, [], label
        self.runs, self.chars, self.linked, self.stops = [], 0, 0, 0


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order, parents first, and the blocks of text: (element, text).

    Comments, scripts and the like are left out, references decoded, white
    space made one blank. Unclosed elements end where the standard ends them.
    """
    nodes = [Node("html", (), -1)]
    stack = [(0, "html")]
    blocks, pending, owner, inline, at = [], [], 0, 0, 0

    def flush():
        nonlocal pending
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            if text:
                blocks.append((owner, text))
                nodes[owner].chars += len(text)
                nodes[owner].stops += text.count(".") + text.count(",")
            pending = []

    page = page or ""
    while True:
        found = _TOKEN.search(page, at)
        text = page[at:found.start()] if found else page[at:]
        if text:
            pending.append(text)
            if inline:
                nodes[owner].linked += len(text)
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag == "a":
                inline = 0
            elif tag in BLOCK:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][1] == tag), 0)
                flush()
                if depth:
                    del stack[depth:]
                    owner, inline = stack[-1][0], 0
            continue
        if tag in RAW:
            end = _END[tag].search(page, at) if not found[3].endswith("/") else None
            if tag == "head":
                continue
            pending.append(" ")
            if end:
                at = end.end()
            elif tag in ("script", "style", "textarea", "title"):
                at = len(page)
            continue
        if tag == "a":
            inline = 1
        elif tag in BLOCK:
            flush()
            inline = 0
            closes = CLOSES.get(tag)
            while len(stack) > 1 and (stack[-1][1] == "p" or closes and stack[-1][1] in closes):
                stack.pop()
            owner = stack[-1][0]
            if tag in ("html",):
                continue
            names = tuple(_names(found[3])) if "=" in found[3] or "hidden" in found[3] else ()
            if tag not in VOID:
                nodes.append(Node(tag, names, owner))
                nodes[owner].kids.append(len(nodes) - 1)
                owner = len(nodes) - 1
                stack.append((owner, tag))
        elif tag in VOID:
            pending.append(" ")
    flush()
    return nodes, blocks


def _names(attributes: str):
    """Words of class, id and role, and marks of hidden elements."""
    for name, *values in _NAMES.findall(attributes):
        value, name = "".join(values), name.lower()
        if name in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                yield "hidden"
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                yield "hidden"
        else:
            for word in _WORDS.findall(value):
                yield word.lower()


def features(nodes: list[Node]) -> list[list[str]]:
    chars, linked, stops = [n.chars for n in nodes], [n.linked for n in nodes], [n.stops for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        chars[up] += chars[i]
        linked[up] += linked[i]
        stops[up] += stops[i]
    found, total = [], max(1, chars[0])
    for i, node in enumerate(nodes):
        n = chars[i]
        own = ["bias", "t:" + node.tag]
        own += ["n:" + name for name in node.names]
        if i:
            own += ["in:" + name for name in nodes[node.parent].names]
            own.append("in-t:" + nodes[node.parent].tag)
        own.append(f"links:{min(4, 5 * linked[i] // n) if n else 'none'}")
        own.append(f"long:{min(12, n.bit_length())}")
        own.append(f"share:{4 * n // total}")
        if n:
            own.append(f"stops:{min(4, 100 * stops[i] // n)}")
        found.append(own)
    return found


class Model:
    def __init__(self, weights=None, pair=None):
        self.weights = weights or {}
        self.pair = pair or [[0.0, 0.0], [0.0, 0.0]]   # [parent][child]

    def marginals(self, nodes, found):
        """Log odds of each node's label and the parts needed for pairs: (up, message to parent, both ways)."""
        (p00, p01), (p10, p11) = self.pair
        exp, log, get = math.exp, math.log, self.weights.get
        e00, e01, e10, e11 = exp(p00), exp(p01), exp(p10), exp(p11)
        up = [max(-30.0, min(30.0, sum([get(f, 0.0) for f in own]))) for own in found]
        sent = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            t = exp(max(-30.0, min(30.0, up[i])))
            sent[i] = log((e10 + e11 * t) / (e00 + e01 * t))
            up[nodes[i].parent] += sent[i]
        odds = up[:]
        for i in range(1, len(nodes)):
            t = exp(max(-30.0, min(30.0, odds[nodes[i].parent] - sent[i])))
            odds[i] = up[i] + log((e01 + e11 * t) / (e00 + e10 * t))
        return odds, up, sent

    def text(self, page: str | None) -> str:
        nodes, blocks = parse(page)
        if not blocks:
            return ""
        odds, _, _ = self.marginals(nodes, features(nodes))
        return "\n".join([text for owner, text in blocks if odds[owner] > 0])


# Words by which the labelled pages, and their rewritten forms, name what is no article.
SIDE = ("nav", "menu", "header", "footer", "sidebar", "aside", "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "cookie",
        "notice", "consent", "alert", "newsletter", "subscribe", "signup", "login", "search", "form", "share", "social", "related", "recommended",
        "comments", "comment", "reply", "replies", "disqus", "discussion", "responses", "commentlist", "thread", "gdpr", "privacy", "breadcrumb", "pagination", "widget", "toolbar", "popup", "modal", "hidden", "tags", "copyright")
SIDE_TAGS = frozenset("nav aside header footer form dialog".split())
BODY_TAGS = frozenset("article main".split())
BODY = (("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "article"), ("div", "entry"), ("section", "story"),
        ("div", "main"), ("div", "post-body"), ("section", ""), ("div", ""))


READERS = ("comments", "comment-list", "commentlist", "discussion", "responses", "replies", "user-posts", "reader-comments", "thread", "disqus", "feedback")


def label(nodes: list[Node]) -> bool:
    """Mark the elements of a page whose article is marked by its tag; false if it has none."""
    any_body = False
    for node in nodes:
        parent = nodes[node.parent] if node.parent >= 0 else None
        inside = node.tag in BODY_TAGS or parent is not None and parent.label == 1
        barred = node.tag in SIDE_TAGS or any(name in SIDE for name in node.names) or parent is not None and parent.label == -1
        node.label = -1 if barred else 1 if inside else 0
        any_body |= inside and not barred
    return any_body


def rewritten(page: str, rng: random.Random, spare: list[str], prose: list[str]) -> str:
    """A labelled page in another form: other names of its article and side parts, further side parts, comments of readers,
    and in the article tables, lists, headings, figures and other elements, filled with stretches of ``prose``.

    Elements keep their label by the attribute ``data-l``, which no feature reads.
    """
    body, cls = rng.choice(BODY)
    pick = lambda: rng.choice(SIDE)

    def side():
        tag = rng.choice(("div", "section", "ul", "aside", "nav", "form", "header", "footer", "div", "div"))
        name = f' class="{pick()}"' if tag in ("div", "section", "ul") or rng.random() < 0.5 else ""
        words = rng.choice(spare).split()
        words = words[:rng.randint(1, max(1, len(words)))]
        if tag == "ul" or rng.random() < 0.3:
            inner = "".join(f"<li><a href='#'>{w}</a></li>" for w in words[:8])
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
        else:
            inner = rng.choice(("<p>{}</p>", "{}", "<h3>{}</h3>", "<div><p>{}</p></div>")).format(" ".join(words))
        return f"<{tag}{name} data-l=0>{inner}</{tag}>"

    def words(most):
        own = rng.choice(prose).split()
        at = rng.randrange(max(1, len(own) - most))
        return " ".join(own[at:at + rng.randint(1, most)]) or "Text"

    def part():
        """What an article may hold besides plain paragraphs."""
        cells = lambda tag: "".join(f"<{tag}>{words(rng.choice((1, 3, 12)))}</{tag}>" for _ in range(columns))
        items = lambda tag: "".join(f"<{tag}>{words(rng.choice((2, 6, 20)))}</{tag}>" for _ in range(rng.randint(2, 6)))
        kind, columns = rng.randrange(9), rng.randint(2, 4)
        if kind == 0:
            return f"<table>{f'<caption>{words(6)}</caption>' if rng.random() < 0.3 else ''}<tr>{cells('th')}</tr>" \
                + "".join(f"<tr>{cells('td')}</tr>" for _ in range(rng.randint(1, 5))) + "</table>"
        if kind in (1, 2):
            tag = ("ul", "ol")[kind - 1]
            return f"<{tag}>{items('li')}</{tag}>"
        if kind == 3:
            return f"<dl>{''.join(f'<dt>{words(2)}</dt><dd>{words(12)}</dd>' for _ in range(rng.randint(1, 4)))}</dl>"
        if kind == 4:
            return f"<header data-l=1>{rng.choice(('<h1>{}</h1>', '<h2>{}</h2>')).format(words(8))}</header>"
        if kind == 5:
            return f"<figure><img src=x><figcaption>{words(12)}</figcaption></figure>"
        if kind == 6:
            return f"<details><summary>{words(5)}</summary><p>{words(30)}</p></details>"
        if kind == 7:
            tag = rng.choice(("pre", "blockquote", "h2", "h3", "h4", "p", "div"))
            return f"<{tag}>{words(rng.choice((1, 4, 30)))}</{tag}>"
        return f"<p>{words(3)}<br>{words(3)}</p>"

    def readers():
        """Comments of readers: some entries of a few words to some sentences, in one of the usual forms."""
        tag, entry = rng.choice((("section", "div"), ("div", "div"), ("ol", "li"), ("ul", "li"), ("section", "article"), ("div", "p"), ("section", "p")))
        name = rng.choice((f'id="{rng.choice(READERS)}"', f'class="{rng.choice(READERS)}"'))
        head = rng.choice(("", "<h2>Comments</h2>", "<h3>{} comments</h3>".format(rng.randint(1, 40)))) if tag not in ("ol", "ul") else ""
        inner = "".join(f"<{entry}>" + (words(20) if entry == "p" else rng.choice(("<p>{}</p>", "<b>{}</b> {}", "{}")).format(words(15), words(25))) + f"</{entry}>"
                        for _ in range(rng.randint(1, 5)))
        return f"<{tag} {name} data-l=0>{head}{inner}</{tag}>"

    inside = False

    def swap(found):
        nonlocal inside
        tag, rest = found[2].lower(), found[3]
        if tag in BODY_TAGS:
            inside = not found[1]
            if found[1]:
                last = part() if rng.random() < 0.3 else ""
                return last + (readers() if rng.random() < 0.25 else "") + f"</{body}>" + (readers() if rng.random() < 0.25 else "")
            named = f" class={chr(34)}{cls}{chr(34)}" if cls else ""
            return f"<{body}{named} data-l=1>" + (part() if rng.random() < 0.3 else "")
        if tag in ("p", "h2") and not found[1] and rng.random() < 0.12:
            return side() + found[0]
        if tag in ("p", "h2") and not found[1] and inside and rng.random() < 0.2:
            return part() + found[0]
        if tag == "div" and "class" in rest and rng.random() < 0.7:
            return f'<div class="{pick()}">'
        return found[0]

    out = re.sub(r"<(/?)(article|main|p|h2|div)\b([^>]*)>", swap, page, flags=re.I)
    if rng.random() < 0.8:
        out = re.sub(r"(<body[^>]*>)", lambda m: m[0] + "".join(side() for _ in range(rng.randint(0, 2))), out, count=1)
    if rng.random() < 0.8:
        out = re.sub(r"(<footer)", lambda m: "".join(side() for _ in range(rng.randint(0, 3))) + m[0], out, count=1)
    return out


def _labelled(page: str):
    """Nodes of a page whose labels are given by tags, names and ``data-l``."""
    marks = []
    plain = re.sub(r"<([a-z0-9]+)((?: [^>]*?)?) data-l=([01])>", lambda m: marks.append(m[3]) or f"<{m[1]}{m[2]} id=lq{'one' if m[3] == '1' else 'nil'}>", page)
    nodes, _ = parse(plain)
    for node in nodes:
        parent = nodes[node.parent] if node.parent >= 0 else None
        mark = 1 if "lqone" in node.names else -1 if "lqnil" in node.names else None
        node.names = tuple(n for n in node.names if n not in ("lqone", "lqnil"))
        side = node.tag in SIDE_TAGS or any(n in SIDE for n in node.names)
        node.label = mark if mark is not None else -1 if side or parent is not None and parent.label == -1 \
            else 1 if node.tag in BODY_TAGS or parent is not None and parent.label == 1 else 0
    return nodes


def train(pages: list[str], seed=0) -> Model:
    """Fit on pages whose article is marked by its tag; others are no examples. The same pages give the same model."""
    rng = random.Random(seed)
    prose = ["A short text stands here, to be read."]
    usable, spare = [], ["Home About Contact", "Subscribe to our letter", "Read more, or reply.", "All rights reserved."]
    for page in sorted(p for p in pages if p):
        nodes, blocks = parse(page)
        if label(nodes):
            usable.append(page)
            spare += [text for owner, text in blocks if nodes[owner].label != 1][:3]
            spare += [text for owner, text in blocks if nodes[owner].label == 1][:1]
            prose += [text for owner, text in blocks if nodes[owner].label == 1][:20]
    model = Model({"bias": -0.5}, [[1.0, -1.0], [-1.0, 1.0]])
    sample = []
    for page in usable:
        for k in range(VARIANTS):
            nodes = _labelled(rewritten(page, rng, spare, prose) if k else page)
            sample.append((nodes, features(nodes)))
    rounds = EPOCHS * len(sample)
    for step in range(rounds):
        if step % len(sample) == 0:
            rng.shuffle(sample)
        nodes, found = sample[step % len(sample)]
        rate = 0.2 * (1 - step / rounds)
        odds, up, sent = model.marginals(nodes, found)
        y = [int(n.label == 1) for n in nodes]
        (p00, p01), (p10, p11) = model.pair
        change = [[0.0, 0.0], [0.0, 0.0]]
        for i, node in enumerate(nodes):
            slope = y[i] - 1 / (1 + math.exp(-max(-30.0, min(30.0, odds[i]))))
            if abs(slope) > 1e-3:
                for f in found[i]:
                    model.weights[f] = model.weights.get(f, 0.0) * (1 - 1e-4 * rate) + rate * slope
            if i:
                above = max(-30.0, min(30.0, odds[node.parent] - sent[i]))
                own = max(-30.0, min(30.0, up[i]))
                joint = [math.exp(p00), math.exp(p01 + own), math.exp(p10 + above), math.exp(p11 + above + own)]
                total = sum(joint)
                change[y[node.parent]][y[i]] += 1
                for k in range(4):
                    change[k // 2][k % 2] -= joint[k] / total
        for a in (0, 1):
            for b in (0, 1):
                model.pair[a][b] = max(-6.0, min(6.0, model.pair[a][b] + 0.05 * rate * change[a][b]))
    return model


def fit(df: DataFrame, id_col="page_id", html_col="html", pages=PAGES, page_chars=PAGE_CHARS) -> Model:
    """Fit on a bounded sample of the pages of up to ``page_chars`` characters whose article is marked by its tag, spread over the table by a hash of the id."""
    rows = df.filter(F.col(html_col).rlike("(?i)<(article|main)[ >]") & (F.length(html_col) <= page_chars))
    n = rows.count()
    if not n:
        return Model({"t:article": 4.0, "t:main": 4.0, "t:p": 1.0, "bias": -0.5}, [[1.0, -1.0], [-1.0, 1.0]])
    chosen = rows.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("pages")), F.lit(1_000_000)) < min(1e6, 1e6 * pages / n))
    return train([r[0] for r in chosen.select(html_col).limit(2 * pages).collect()])


def extract(df: DataFrame, model: Model, id_col="page_id", html_col="html", others=("url",)) -> DataFrame:
    """``id_col``, ``others``, ``text`` for every page: its blocks in page order, one a line.

    Null and empty pages, and pages without content, give an empty text. Of
    ``others`` only columns that are there come out.
    Repeated rows come out as often as they are; further columns are left out.
    One pass, no shuffle; each page is handled alone.
    """
    others = [c for c in others if c in df.columns]
    shared = ship(df.sparkSession, model, "pages")  # one weight per element or class name of the examples

    def run(batches):
        import pyarrow as pa

        known = shared()
        for batch in slices(batches):
            texts = [known.text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[id_col, *others, "text"])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, *others)]
    return df.select(id_col, *others, F.col(html_col).cast("string")).mapInArrow(run, ", ".join(kinds) + ", text string")
