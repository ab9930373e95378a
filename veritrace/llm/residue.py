"""Template residue, filler, error pages and script notices: regularised linear classifiers on hashed n-grams.

Two units are judged. A segment is a line or sentence; its features are word n-grams, length, script and title. A candidate for
a slot is anything of its shape: a short name in any script between brackets or repeated signs, or a rule of underscores inside
a sentence; its features are the signs, the spelling of the name and its words, what touches it, the words around it, and how
often the text has the same signs. No list of spellings decides what is a candidate.

Weak labels come from response-status lines and phrases (CUES, by family) and from well-known spellings of slots (SLOTS, by family): a
document that cues cover for the most part gives positive segments, one without cues or one in which they are a small part
(content that quotes an error) gives negative ones; candidates of a well-known spelling are positive where a segment has two or
more of them, negative inside code or where they are spoken about, and open where they stand alone; candidates in documents
without any well-known spelling are negative. On a bounded sample of labelled documents logistic regressions with L2 penalty are
trained. To validate, some hosts (the source column) are left out of training and all their documents judged, and so they are with
each family of labels withheld, which shows how far what was learned goes beyond the lists.

Every document is judged in whole: it is residue if a candidate is positive, or if positive segments make up at least SHARE
of its characters, headings apart. Scanning stops only when no later segment can change that.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrace.llm.records import HAN

#: Hash space of the features.
SPACE = 1 << 20
#: The bounded sample: about LOOKED documents are drawn by a seeded hash, none of more than SAMPLE_CHARS characters; of
#: them at most SAMPLE that may have cues or slots and OTHERS of the rest are labelled.
LOOKED, SAMPLE, OTHERS, SAMPLE_CHARS, SEED = 20_000, 4_000, 2_000, 20_000, 11
#: One host in HELD_OUT is kept for validation.
HELD_OUT = 5
SHARE = 0.7
#: Log odds from which on a segment or a candidate is positive.
SURE = 1.0
#: Words of a segment in which a cue isn't taken for a quotation.
BRIEF = 14
L2, EPOCHS, STEP = 1e-5, 8, 0.3

#: Rows of one text and label that are trained on; the same line in thousands of documents isn't that much more evidence.
MOST_REPEATS = 20

#: Phrases of weak labels by family; matched in lower case.
CUES = {
    "error": r"\b[45]\d\d (?:not found|forbidden|bad gateway|internal server error|service unavailable|unauthorized|gateway timeout|bad request|too many requests|-)|"
    r"\b(?:http|error|erreur|fehler|código|status)\s*:?\s*[45]\d\d\b|gateway timeout|bad gateway|too many requests|access denied|accès refusé|acceso denegado|zugriff verweigert|"
    r"internal server error|service unavailable|something went wrong|(?:page|seite|página|record|eintrag|registro) (?:not found|introuvable|nicht gefunden|no encontrada|existiert nicht)|"
    r"could not (?:be (?:located|satisfied)|load)|no longer available|did not respond in time|session has expired|connection refused|failed to render|wandered off|down for maintenance|"
    r"页面不存在|系统繁忙|访问被拒绝|服务器错误",
    "script": r"javascript|noscript|scripts? (?:are|is) (?:blocked|disabled)|turn on scripts|allow scripting|supports scripting|scripts and cookies",
    "filler": r"lorem|ipsum|placeholder|goes here|coming soon|sample text|beispieltext|texto de ejemplo|texte provisoire|to be written later|no content yet|in this box|此处填写|占位|"
    r"\b(tbd|todo|text|blah|test|dummy|xxx|zzz|asdf|foo)(?: \1){2,}|\b(?:asdf|blah|zzz|xxx|test|jkl;?|dummy|abc123|qwer|qwerty|foo|bar)(?: (?:asdf|blah|zzz|xxx|test|jkl;?|dummy|abc123|qwer|qwerty|foo|bar)){2,}",
}
_NAME = r"[A-Za-z][\w.-]*(?: [A-Za-z][\w.-]*){0,5}"
#: Well-known spellings of slots by family; they give weak labels, candidates are found by shape.
SLOTS = {
    "double": rf"\{{\{{\s*{_NAME}\s*\}}\}}|<<\s*{_NAME}\s*>>|\[\[\s*{_NAME}\s*\]\]",
    "sigil": rf"\$\{{\s*{_NAME}\s*\}}|#\{{\s*{_NAME}\s*\}}|\{{%\s*{_NAME}\s*%\}}|<%=?\s*{_NAME}\s*%>|%\({_NAME}\)[sd]",
    "repeated": r"%[A-Za-z][A-Za-z_]+%|__[A-Z][A-Z_]*__|@@\w+@@|\$\$\w+\$\$",
    "angle": rf"«\s*{_NAME}\s*»|<(?!/?(?:s|p|b|i|a|h[1-6]|br|hr|li|ul|ol|td|tr|th|em|div|pre|img|html|head|body|meta|span|code|table|title|style|script|strong|unk|pad|bos|eos|mask|sep|cls)\b)[a-z][a-z_]*(?: [a-z_]+){{0,5}}>",
    "square": r"\[[A-Za-z][A-Za-z_]+(?: [A-Za-z_]+){0,5}\]",
    "brace": r"\{(?<![\w\"'(]\{)[a-z][a-z_]*\}",
    "words": r"\((?:fill in|insert|enter|your)\b[^)\n]{0,40}\)",
    "rule": r"_(?<!__)__+(?=[,.;: ])(?<!_{9})",
}
_CUES = {f: re.compile(x) for f, x in CUES.items()}
_SLOTS = {f: re.compile(x) for f, x in SLOTS.items()}
_ANY_CUE, SLOT = re.compile("|".join(CUES.values()).replace("\\1", "(?:tbd|todo|text|blah|test|dummy|xxx|zzz|asdf|foo)")), re.compile("|".join(SLOTS.values()))
#: The shape of a slot: a name of at most six words between brackets, with or without signs inside or before them, or between
#: equal pairs of signs; or a rule of underscores in front of a blank or punctuation.
_SIGNS = re.compile(r"[{\[<(«【「《⟨‹%]|__|@@|\$\$|##|~~|\|\|")
_INNER = r"[^\W\d_](?:[\w.-]*?[^\W_])?(?: [^\W_](?:[\w.-]*?[^\W_])?){0,5}"
SHAPE = re.compile(
    rf"(?P<open>[$#%@]{{0,2}}[{{(\[<«【「《⟨‹]{{1,3}}[%=#]{{0,2}})\s*(?P<name>{_INNER})\s*(?P<close>[%=]?[}})\]>»】」》⟩›]{{1,3}}[sd]?)|(?P<sign>%|__|@@|\$\$|%%|##|~~|\|\|)(?P<name2>{_INNER})(?P=sign)|(?<!_)(?P<rule>_{{3,8}})(?=[,.;: ])"
)
#: Signs that a slot is code or is spoken about.
_SPOKEN = re.compile(r"`|\bexport \w|\bselect\b.*\bfrom\b|\blike '|\bdef \w|\breturn f?[\"']|f[\"'].*\{|\bforbids?\b|\bfields? are\b|\bis expanded\b|\bcontains?\b|\bvariables?\b|\bplaceholders? (?:named|called)|\bsyntax\b|\btemplate file\b")
_TAG = re.compile(r"</?(?:html|head|body|title|h[1-6]|p|div|span|br|hr|li|ul|ol|td|tr|th|table|a|b|i|em|strong|pre|code|meta|img|style|script|noscript)\b[^<>]*>", re.I)
_SPLIT = re.compile(r"\n+|(?<=[.!?…])\s+(?=\S)|(?<=[。！？])|\s{2,}")
#: Words; a path, a name with dots inside and a mix of letters and digits are one each.
_TOKEN = re.compile(f"\x01|[{HAN}]|[~.]?/[a-z0-9_./-]+|[a-z0-9_-]+(?:\\.[a-z0-9_-]+)+|[a-z]+\\d[a-z\\d]*|\\d+[a-z][a-z\\d]*|[^\\W\\d_{HAN}]+|\\d+|[|©]")
_STATUS = re.compile(r"[45]\d\d")
_HAN = re.compile(f"[{HAN}]")
_LETTER = re.compile(r"[A-Za-z]")


def segments(text: str) -> list[str]:
    """Lines and sentences of a text without page tags, blank ones left out."""
    if "<" in text:
        text = _TAG.sub("\n", text)
    return [s for s in (x.strip() for x in _SPLIT.split(text)) if s and any(c.isalnum() for c in s)]


def is_heading(segment: str, place: int) -> bool:
    """A first line that is short and doesn't end as a sentence, or one that is marked as a heading."""
    return segment.startswith("#") or (place == 0 and len(segment) <= 40 and segment[-1] not in ".!?。！？…" and not _ANY_CUE.search(segment.lower()) and not SHAPE.search(segment))


def _kind(word: str) -> str:
    """Of a token that isn't letters alone."""
    if word.isdigit():
        return "<status>" if _STATUS.fullmatch(word) else "<n>" if len(word) < 7 else "<code>"
    return word if len(word) == 1 else "<path>" if "/" in word else "<host>" if "." in word else "<code>"


def words_of(segment: str) -> set[str]:
    """The word features of a segment by name: 1-grams and 2-grams, with slots and numbers as words."""
    words = [w if w.isalpha() else _kind(w) for w in _TOKEN.findall(SLOT.sub(" \x01 ", segment).lower())]
    return {*words, *map("{} {}".format, words, words[1:])}


def script_of(segment: str) -> str:
    """Of most letters: latin, han, other, or none without letters."""
    if segment.isascii():
        return "latin" if _LETTER.search(segment) else "none"
    letters = [c for c in segment if c.isalpha()]
    if not letters:
        return "none"
    latin = sum(c < "\u0250" for c in letters)
    han = len(_HAN.findall(segment))
    return "latin" if 2 * latin >= len(letters) else "han" if 2 * han >= len(letters) else "other"


def shape_of(segment: str, place: int) -> tuple[str, ...]:
    """Its length, script and title features, and the bias."""
    n = segment.count(" ") + 1
    script = script_of(segment)
    return (f"len:{min(9, n.bit_length())}", f"end:{segment[-1] in '.!?。！？'}", f"title:{place == 0}:{n < 8}", f"script:{script}", f"script:{script}:{min(9, n.bit_length())}", "bias")


def names(segment: str, place: int) -> set[str]:
    return words_of(segment).union(shape_of(segment, place))


def number(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % SPACE


_FIELD = re.compile(r"[^\W\d_]+|\d+")
_TOUCH = {"`": "quote", '"': "quote", "'": "quote", "“": "quote", "”": "quote", "=": "equals", "/": "path", "(": "bracket", ")": "bracket", "\\": "path", ":": "colon"}


def _touching(c: str) -> str:
    return "none" if not c else "space" if c.isspace() else "han" if _HAN.match(c) else _TOUCH.get(c) or ("letter" if c.isalnum() else "mark")


def slot_names(segment: str, m: re.Match, same: int) -> set[str]:
    """The features of a candidate for a slot: its signs, the spelling and words of its name, and what stands around it."""
    name = m["name"] or m["name2"] or ""
    signs = (m["open"] or m["sign"] or "_", m["close"] or m["sign"] or "_")
    words = _FIELD.findall(name.lower())
    a, b = m.span()
    before, after = [[w if w.isalpha() else _kind(w) for w in _TOKEN.findall(x)] for x in (segment[max(0, a - 60) : a].lower(), segment[b : b + 60].lower())]
    case = "none" if not name else "upper" if name.isupper() else "lower" if name.islower() else "title" if name.istitle() else "mixed" if name[0].isascii() else "other"
    join = "_" if "_" in name else "-" if "-" in name else "." if "." in name else " " if " " in name else ""
    out = {
        "s|bias", f"s|open:{signs[0]}", f"s|pair:{signs[0]}:{signs[1]}", f"s|width:{len(signs[0])}", f"s|case:{case}", f"s|join:{join}", f"s|case:{case}:{join}", f"s|words:{min(4, len(words))}", f"s|same:{min(3, same)}",
        f"s|before:{_touching(segment[a - 1 : a])}", f"s|after:{_touching(segment[b : b + 1])}", f"s|short:{len(name) < 3}", f"s|script:{script_of(name)}", f"s|code:{bool(_CODE.search(segment))}", f"s|round:{signs[0] == '('}", f"s|round:{signs[0] == '('}:{case}:{join}",
    }
    out.update(f"s|in:{w}" for w in words)
    out.update(f"s|near:{w}" for w in (*before[-6:], *after[:6]))
    out.update((f"s|left:{' '.join(before[-1:])}", f"s|left:{' '.join(before[-2:])}", f"s|right:{' '.join(after[:1])}", f"s|right:{' '.join(after[:2])}"))
    return out


#: Signs of code.
_CODE = re.compile(r"`|==|=>|->|;\s*$|\b(?:def|return|export|select|function|const|import)\b|[\w]\(|&&|\$\(", re.I)


def candidates(parts: list[str]) -> Iterator[tuple[int, re.Match, int]]:
    """(place of the segment, match, how often the text has the same signs) of each candidate for a slot."""
    found = [(k, m) for k, s in enumerate(parts) for m in SHAPE.finditer(s)]
    signs = [m["open"] or m["sign"] or "_" for _, m in found]
    for (k, m), sign in zip(found, signs):
        yield k, m, signs.count(sign) if len(signs) < 50 else 3


class Scorer(dict):
    """Weight of each feature by name, hashed when first met."""

    def __init__(self, weight: np.ndarray) -> None:
        super().__init__()
        self.weight = weight

    def __missing__(self, name: str) -> float:
        w = float(self.weight[number(name)])
        if len(self) < 500_000:
            self[name] = w
        return w

    def positive(self, segment: str, place: int) -> bool:
        return sum(map(self.__getitem__, names(segment, place))) > SURE

    def slot(self, segment: str, m: re.Match, same: int) -> bool:
        return sum(map(self.__getitem__, slot_names(segment, m, same))) > SURE


def weak_labels(text: str, withheld: str = "") -> tuple[list[tuple[str, int, int]], list[tuple[int, re.Match, int, int]]]:
    """Of the segments and of the candidates that weak labels decide: (segment, place, label), (place, match, same, label).

    A cue tells in a segment of at most BRIEF words, or where cues recur or are most of it (filler); in a longer sentence
    it is quoted. A document with anything of the withheld family gives no labels.
    """
    parts = segments(text)
    low = text.lower()
    if withheld and (_CUES[withheld].search(low) if withheld in _CUES else _SLOTS[withheld].search(text)):
        return [], []
    shaped = list(candidates(parts))
    if not _ANY_CUE.search(low) and not SLOT.search(text):
        return [(s, k, 0) for k, s in enumerate(parts) if not is_heading(s, k)], [(*c, 0) for c in shaped]
    slots = [[m.span() for m in SLOT.finditer(s)] for s in parts]
    brief = [len(_HAN.sub("", s).split()) + len(_HAN.findall(s)) / 3 <= BRIEF for s in parts]
    cued, quoted = [], []
    for k, s in enumerate(parts):
        found = [len(m[0]) for m in _ANY_CUE.finditer(s.lower())]
        quoted.append(bool(found))
        cued.append(bool(found) if brief[k] else len(found) > 2 or sum(found) >= 0.4 * len(s))
    out, kept = [], []
    plain = [(s, k) for k, s in enumerate(parts) if not slots[k] and not is_heading(s, k)]
    size = sum(len(s) for s, _ in plain)
    covered = sum(len(s) for s, k in plain if cued[k])
    unsure = sum(len(s) for s, k in plain if quoted[k] and not cued[k])
    label = 0 if covered <= 0.1 * size and unsure <= 0.5 * size else 1 if covered >= 0.15 * size and all(brief[k] or cued[k] for _, k in plain) else None
    if label is not None:
        out += [(s, k, label) for s, k in plain]
    for k, m, same in shaped:
        known = any(a < m.end() and m.start() < b for a, b in slots[k])
        if known and _SPOKEN.search(parts[k].lower()):
            kept.append((k, m, same, 0))
        elif known and len(slots[k]) >= 2:
            kept.append((k, m, same, 1))
        elif not any(slots):
            kept.append((k, m, same, 0))
    return out, kept


def train(rows: list[tuple[list[int], int]], seed: int = SEED) -> np.ndarray:
    """Weights of a logistic regression with L2 penalty: AdaGrad on batches, classes weighted alike."""
    weight, sums = np.zeros(SPACE), np.full(SPACE, 1e-8)
    if not rows:
        return weight.astype(np.float32)
    labels = np.array([y for _, y in rows], float)
    positive = max(1.0, labels.sum())
    cost = np.where(labels == 1, len(rows) / (2 * positive), len(rows) / (2 * max(1.0, len(rows) - positive)))
    sizes = np.array([len(f) for f, _ in rows])
    flat = np.fromiter((x for f, _ in rows for x in f), np.int64, int(sizes.sum()))
    start = np.r_[0, np.cumsum(sizes)]
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            n = sizes[batch]
            at = flat[np.repeat(start[batch] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            row = np.repeat(np.arange(len(batch)), n)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weight[at], len(batch)), -30, 30)))
            used, back = np.unique(at, return_inverse=True)
            g = np.bincount(back, ((p - labels[batch]) * cost[batch])[row], len(used)) / len(batch) + L2 * weight[used]
            sums[used] += g * g
            weight[used] -= STEP * g / np.sqrt(sums[used])
    return weight.astype(np.float32)


def judge(text: str, scorer: Scorer) -> str | None:
    """The kind of residue, or None for content. Empty texts and texts without letters or digits are content."""
    if not text or text.isspace():
        return None
    parts = segments(text)
    if _SIGNS.search(text) and any(scorer.slot(parts[k], m, same) for k, m, same in candidates(parts)):
        return "slot"
    body = [(s, k) for k, s in enumerate(parts) if not (k == 0 or s[0] == "#") or not is_heading(s, k)]
    total = sum(len(s) for s, _ in body)
    bad = good = 0
    for s, k in sorted(body, key=lambda b: -len(b[0])):
        if scorer.positive(s, k):
            bad += len(s)
        else:
            good += len(s)
            if good > (1 - SHARE) * total:
                return None
    return "whole" if bad else None


_KEPT: dict[str, Scorer] = {}


def _scorer(key: str, weight) -> Scorer:
    """One for each worker process, kept between the partitions that it takes."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Scorer(weight())
    return _KEPT[key]


def _judged(weights, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, lambda: weights.value)
        for batch in batches:
            kinds = [judge(t, scorer) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], names=["doc_id", "kind"])

    return run


def _held_host(source: str | None) -> bool:
    return zlib.crc32((source or "").encode()) % HELD_OUT == 0


def _sample(docs: DataFrame) -> list[tuple[str | None, str]]:
    """At most SAMPLE + OTHERS documents for the driver, each of at most SAMPLE_CHARS characters."""
    order = F.xxhash64("doc_id", F.lit(SEED))
    share = min(1.0, LOOKED / max(1, docs.count()))
    drawn = docs.filter(order < int((2 * share - 1) * (2**63 - 1))) if share < 1 else docs
    rows = drawn.select("doc_id", "source", "text", order.alias("o")).filter((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS))
    maybe = F.lower("text").rlike("|".join(CUES.values())) | F.col("text").rlike(r"\{\{|[$#]\{|\{[a-z%]|<[a-z]+[ _a-z]*>|<[<%]|\[[A-Za-z\[]|%[A-Za-z(]|@@|\$\$|__[A-Z]|«|\((?:fill|insert|enter|your)\b")
    # one pass; what is shuffled are the LOOKED documents at most
    place = F.row_number().over(Window.partitionBy("maybe").orderBy("o", "doc_id"))
    kept = rows.withColumn("maybe", maybe).withColumn("k", place).filter(F.col("k") <= F.when(F.col("maybe"), SAMPLE).otherwise(OTHERS))
    return [(r.source, r.text) for r in kept.orderBy("o", "doc_id").select("source", "text").collect()]


def fit(sample: list[tuple[str | None, str]], held: bool = False, withheld: str = "") -> tuple[np.ndarray, int]:
    """(weights, rows): trained on all hosts or, with held, on those that aren't held out, without the labels of a family."""
    seen: dict[tuple[str, int], int] = {}

    def often(text: str, label: int) -> bool:
        seen[text, label] = seen.get((text, label), 0) + 1
        return seen[text, label] > MOST_REPEATS

    rows: list[tuple[list[int], int]] = []
    slots: list[tuple[list[int], int]] = []
    for source, text in sample:
        if held and _held_host(source):
            continue
        labelled, found = weak_labels(text, withheld)
        rows += [(sorted(set(map(number, names(s, k)))), y) for s, k, y in labelled if not often(s, y)]
        parts = segments(text) if found else []
        slots += [(sorted(set(map(number, slot_names(parts[k], m, same)))), y) for k, m, same, y in found if not often(f"{m[0]}\0{parts[k]}", y)]
    return train(rows) + train(slots), len(rows) + len(slots)


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, kind) of every document with a text; kind is 'slot', 'whole' or null for content.

    docs: doc_id, source, text; other columns are ignored. Null texts are left out, empty and blank ones are content. Rows
    that repeat a document come out repeatedly. An empty table, or one without any labelled segment, gives content only.
    """
    weight, _ = fit(_sample(docs))
    weights = docs.sparkSession.sparkContext.broadcast(weight)
    return docs.select("doc_id", "text").filter("text is not null").mapInArrow(_judged(weights, uuid.uuid4().hex), "doc_id long, kind string")


def residue_documents(docs: DataFrame) -> DataFrame:
    """doc_id of each document to leave out."""
    return judged(docs).filter("kind is not null").select("doc_id").distinct()


def residue_report(docs: DataFrame) -> DataFrame:
    """Per source: documents, those left out by kind, and those kept."""
    kinds = judged(docs).dropDuplicates(["doc_id"])
    return (
        docs.select("doc_id", "source").dropDuplicates(["doc_id"]).join(kinds, "doc_id", "left").groupBy("source").agg(
            F.count("*").alias("n_docs"), F.count_if(F.col("kind") == "slot").alias("n_slot"), F.count_if(F.col("kind") == "whole").alias("n_whole"), F.count_if(F.col("kind").isNull()).alias("n_kept")
        )
    )


def weak_kind(text: str) -> tuple[str | None, set[str]]:
    """What the weak labels say of a whole document ('slot', 'whole', 'content', None if they leave it open), and its families."""
    labelled, found = weak_labels(text)
    families = {f for f, x in _CUES.items() if x.search(text.lower())} | {f for f, x in _SLOTS.items() if x.search(text)}
    if any(y for *_, y in found):
        return "slot", families
    size = sum(len(s) for s in segments(text))
    if sum(len(s) for s, _, y in labelled if y) >= SHARE * size > 0:
        return "whole", families
    return ("content" if labelled and not any(y for *_, y in labelled) and (found or not SLOT.search(text)) else None), families


def _compared(weights, withheld: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(w) for w in weights.value]
        counts = np.zeros((len(withheld), 4), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                want, families = weak_kind(text)
                if want:
                    for i, family in enumerate(withheld):
                        if not family or family in families:
                            found = judge(text, scorers[i]) is not None
                            counts[i, (0 if found else 1) if want != "content" else (2 if found else 3)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(withheld), *(pa.array(counts[:, c]) for c in range(4))], names=["withheld", "tp", "fn", "fp", "tn"])

    return run


def validation(docs: DataFrame) -> DataFrame:
    """(withheld, trained_on, n_residue, n_content, recall, precision): documents of hosts that weren't trained on, against weak labels.

    All their documents that weak labels decide are judged in whole. withheld is '' for training with all labels; with the labels of
    a family withheld, the documents that have something of that family are judged. A rate without documents is null.
    """
    sample, withheld = _sample(docs), ["", *CUES, *SLOTS]
    fitted = [fit(sample, True, f) for f in withheld]
    weights = docs.sparkSession.sparkContext.broadcast([w for w, _ in fitted])
    hosts = docs.filter(F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(HELD_OUT)) == 0)
    counts = hosts.filter("text is not null").select("text").mapInArrow(_compared(weights, withheld), "withheld string, tp long, fn long, fp long, tn long").groupBy("withheld").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn")])
    sizes = docs.sparkSession.createDataFrame([(f, n) for f, (_, n) in zip(withheld, fitted)], "withheld string, trained_on long")
    c = lambda x: F.coalesce(x, F.lit(0))
    rate = lambda a, b: F.round(F.try_divide(c(a), c(a) + c(b)), 6)
    return sizes.join(counts, "withheld", "left").select("withheld", "trained_on", (c("tp") + c("fn")).alias("n_residue"), (c("fp") + c("tn")).alias("n_content"), rate("tp", "fn").alias("recall"), rate("tp", "fp").alias("precision"))
