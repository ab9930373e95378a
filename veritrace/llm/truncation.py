"""Texts that end before their author had finished: word trigrams inside texts against trigrams at ends, in SQL.

Texts become tokens: words, numbers, codes, commas and the like, and the marks that end a sentence. Words that are
rare in the corpus (names) count as one token <r>, numbers as <n>, codes as <c>. Every trigram is counted over all texts,
with how often it stands at the end of a sentence or text. Each text is then judged by its last trigram, backed off to
the last two tokens and the last one where the trigram is too rare to tell:

* mid-sentence: the trigram is frequent, but almost never at an end;
* mid-word: the last word hardly occurs after the two before it, but is the beginning of words that often do;
* mark: the text ends in something that cutting leaves. Which endings those are isn't listed but counted: a tail
  (dots, broken characters, or a short bracketed group) is a mark if in many of the texts that end in it the trigram in
  front of it is mid-sentence or mid-word. A tail in too few texts is judged with all tails of its shape.

A path or a name with dots inside is one token of its text, which shows where a sentence was cut after one; its parts are a
sequence of their own (t = 'p'), counted in the same pass, which shows where it was cut itself.

Everything is counted over all texts by partial aggregation. Texts that end alike are judged once, as a group; what is
joined back are the groups that show a cut, hot ones spread. A length limit as such is no sign: whole texts reach it too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.operators.skew import skew_join
from veritrace.runtime import materialize

#: A word is rare if it is in fewer than RARE_SHARE of the texts, or in fewer than RARE_LEAST of them.
RARE_SHARE, RARE_LEAST = 1e-3, 5
#: Texts are counted by the hash of each word in this many cells; words that share a cell are rare or not together. One bit
#: a cell goes into the plan (128 KB, whatever the corpus and its texts).
CELLS = 1 << 20
#: A context decides from ENOUGH occurrences on; it is almost never at an end up to the share ALMOST_NEVER.
ENOUGH, ALMOST_NEVER = 8, 0.02
#: In front of an end mark, which may be the dot inside a name, a trigram must be this frequent, and this rarely at an end.
ENOUGH_ENDED, NEVER_ENDED = 50, 0.005
#: A tail is a mark if this share of the texts that end in it is cut in front of it.
MARKED = 0.25

#: What may turn out to be a mark: dots, broken characters, a bracketed group of at most 40 characters that isn't a path.
TAIL = r"(?:\.{2,}|…+|\x{FFFD}+|[\[<⟨({【（][^\[\]<>⟨⟩(){}【】（）/\n]{1,40}[\]>⟩)}】）])\s*$"
#: Characters that a tail ends in, to try the pattern on few texts.
TAIL_ENDS = ("]", ">", "⟩", ")", "}", "】", "）", "…", "\ufffd")
_W = r"a-z0-9[\p{L}\p{M}\p{N}&&[^\p{IsHan}\x00-\x7f]]"
#: What repeats is possessive, so that a long run of one sign takes no more time than its length. A path; a word, or a name with dots inside; a Han character; a comma and the like before white space; an end mark.
TOKEN = (
    rf"(?<!/)[~.]?/[{_W}_./~-]*[{_W}_]|[{_W}]++(?:(?:[_-]++[{_W}]*+)*+(?:\.[{_W}_-]++)++)?|\p{{IsHan}}|[,;:](?=\s|$)|[，、；：]|[。？！]+|"
    r"[.?!]+(?=[\"'”»)\]`]*(?:\s|$))"
)


#: Among joined tokens, a path or a name with dots inside.
PATH = r"(?<![^ ])[^ /.]*+(?:/|\.(?=[^ .?!]))[^ ]*"


def _with_tokens(rows: DataFrame, text: str, w: str, p: str) -> DataFrame:
    """Adds the tokens of a text joined by blanks: w with paths and names with dots inside as <p>, p with their parts, each marked by a /.

    p is empty for a text without any. Joined tokens are written in far less time than arrays. Each step is a projection of its own, so that a text is taken through it
    once.
    """
    c = F.col
    rows = rows.withColumn(w, F.array_join(F.regexp_extract_all(F.lower(c(text)), F.lit(TOKEN), F.lit(0)), " "))
    rows = rows.withColumn(p, F.when(F.contains(c(w), F.lit("/")) | c(w).rlike(r"\.[^ .?!]"), F.regexp_replace(w, PATH, "/$0")).otherwise(""))
    rows = rows.withColumn(w, F.when(c(p) == "", c(w)).otherwise(F.regexp_replace(w, PATH, "<p>")))
    return rows.withColumn(p, F.when(c(p) == "", "").otherwise(F.ltrim(F.regexp_replace(p, r" ?[/~_.-]+(?=[^ .?!])", " /"))))


def _cell(x: Column) -> Column:
    return F.xxhash64(x).bitwiseAND(CELLS - 1)


def _frequent(texts: DataFrame, rare: int) -> Column:
    """The cells of frequent words as an array of longs, a bit a cell; at most CELLS / 64 rows reach the driver."""
    both = F.when(F.col("p") == "", F.col("w")).otherwise(F.replace("p", F.lit("/"), F.lit("")))
    words = texts.select(F.explode(F.array_distinct(F.split(both, " "))).alias("x")).filter(~_number(F.col("x"))).groupBy(_cell(F.col("x")).alias("cell")).agg(F.count("*").alias("n"))
    slots = words.filter(F.col("n") >= rare).groupBy(F.shiftright("cell", 6).cast("int").alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("bits"))
    bits = [0] * (CELLS // 64)
    for r in slots.collect():
        bits[r.slot] = r.bits
    return F.from_json(F.lit(str(bits)), "array<bigint>")  # folded into one literal


def _number(x: Column) -> Column:
    """A number, or a code that begins with a digit."""
    return (x >= "0") & (x < ":")


def _is_end(x: Column) -> Column:
    return F.left(x, F.lit(1)).isin(".", "?", "!", "。", "？", "！")


def _shape(x: Column, bits: Column) -> Column:
    known = F.getbit(F.get(bits, F.shiftright(_cell(x), 6).cast("int")), _cell(x).bitwiseAND(63).cast("int")) == 1
    return F.when(known, x).when(_number(x), F.when(x.rlike("^[0-9]+$"), "<n>").otherwise("<c>")).when(_is_end(x), "<.>").when(x == "<p>", x).otherwise("<r>")


def _grams(texts: DataFrame, bits: Column) -> DataFrame:
    """(t, a, b, c, n, e): every trigram, how often it occurs, and how often at the end of a sentence or text."""
    at = lambda k: F.get("s", F.col("k") + k)

    def each(col: str, t: str, shape: Callable[[Column], Column], kept: Column) -> DataFrame:
        before = lambda k: F.when(F.col("k") >= k, shape(at(-k))).otherwise("<s>")
        tokens = texts.filter(F.col(col) != "").select(F.split(col, " ").alias("s"))
        places = tokens.select("s", F.explode(F.sequence(F.lit(0), F.size("s") - 1)).alias("k")).filter(~_is_end(at(0)) & kept)
        return places.select(before(2).alias("a"), before(1).alias("b"), shape(at(0)).alias("c"), ((F.col("k") == F.size("s") - 1) | _is_end(at(1))).alias("end"), F.lit(t).alias("t"))

    of_path = lambda k: F.coalesce(F.startswith(at(k), F.lit("/")), F.lit(False))
    w = each("w", "w", lambda x: _shape(x, bits), F.lit(True))
    p = each("p", "p", lambda x: _shape(_part(x), bits), of_path(0) | of_path(-1) | of_path(-2))
    is_w, end = F.col("t") == "w", F.col("end")
    counts = w.unionByName(p).groupBy("a", "b", "c").agg(F.count_if(is_w).alias("nw"), F.count_if(is_w & end).alias("ew"), F.count_if(~is_w).alias("np"), F.count_if(~is_w & end).alias("ep"))
    counts = materialize(counts, "cut-trigrams")
    plain = F.when((F.col("a") == "<p>") | (F.col("b") == "<p>") | (F.col("c") == "<p>"), 0).otherwise(1)
    of = lambda t, n, e: counts.select(F.lit(t).alias("t"), "a", "b", "c", n.alias("n"), e.alias("e")).filter("n > 0")
    return of("w", F.col("nw"), F.col("ew")).unionByName(of("p", F.col("np") + plain * F.col("nw"), F.col("ep") + plain * F.col("ew")))


def _part(x: Column) -> Column:
    return F.ltrim(x, F.lit("/"))


#: The last trigram of each text and of a path that it ends in, in front of an end mark if there is one; v = 1: of the text in front
#: of its tail. x are the last tokens, s their shapes; own: whether its own trigram was counted as one at an end.
_LAST = """
    select key, t, v, ended, x[z] as last, if(z > 1, s[z - 2], '<s>') as a, if(z > 0, s[z - 1], '<s>') as b, s[z] as c, own or ended as own
    from (select *, size(s) - if(ended, 2, 1) as z from (select *, left(x[size(x) - 1], 1) in ('.', '?', '!', '。', '？', '！') as ended from {ends} where size(s) > 0))
    where z >= 0 and left(x[z], 1) not in ('.', '?', '!', '。', '？', '！')
"""
#: How often words that begin with a given text, and are longer, stand after a context.
_LONGER = "select t, %s, left(c, l) as p, sum(n) as n from (select *, explode(sequence(1, length(c) - 1)) as l from {%s} where length(c) > 1 and c rlike r'^\\p{{L}}+$') group by all"
_EVIDENCE = r"""
    select o.*, g.n - 1 as n3, g.e - own::int as e3, p.n - 1 as n2, p.e - own::int as e2, u.n - 1 as n1, u.e - own::int as e1,
           coalesce(l3.n, 0) as l3, coalesce(l2.n, 0) as l2, coalesce(r.n, 0) as nr, coalesce(r.e, 0) as er
    from (select distinct t, ended, last, a, b, c, own, if(ended or not last rlike r'^\p{{L}}+$', null, last) as p from {last}) o
    left join {grams} g on o.t = g.t and o.a = g.a and o.b = g.b and o.c = g.c
    left join {pairs} p on o.t = p.t and o.b = p.b and o.c = p.c
    left join {singles} u on o.t = u.t and o.c = u.c
    left join {grams} r on o.t = r.t and o.a = r.a and o.b = r.b and r.c = '<r>'
    left join {longer3} l3 on o.t = l3.t and o.a = l3.a and o.b = l3.b and o.p = l3.p
    left join {longer2} l2 on o.t = l2.t and o.b = l2.b and o.p = l2.p
"""
#: Of the evidence (without the text itself): the sign of a cut, or null.
_SIGN = rf"""
    case when ended then if(n3 >= {ENOUGH_ENDED} and e3 <= {NEVER_ENDED} * n3, 'mid-sentence', null)
         when l3 >= greatest(3, 2 * (n3 + 1)) then 'mid-word'
         when n3 < {ENOUGH} and l2 >= greatest({ENOUGH}, if(c = '<r>', 0.2, 5) * (n2 + 1)) then 'mid-word'
         when n3 >= {ENOUGH} then
              if(e3 <= {ALMOST_NEVER} * n3 or (e3 <= 3 and e3 <= 0.2 * n3 and n2 >= {ENOUGH_ENDED} and e2 <= {ALMOST_NEVER} * n2), 'mid-sentence', null)
         when length(last) <= 2 and c rlike r'^\p{{L}}' and nr >= {ENOUGH} and er <= {ALMOST_NEVER} * nr then 'mid-word'
         when n2 >= {ENOUGH} then if(e2 <= {ALMOST_NEVER} * n2, 'mid-sentence', null)
         when n1 >= {ENOUGH} and c not like '<%' and e1 <= {ALMOST_NEVER} * n1 then 'mid-sentence'
    end
""".replace("\\\\", "\\")
#: Tails that are marks, by how many of the texts that end in them are cut in front of them.
_MARKS = f"""
    with forms as (select form, any_value(class) as class, count(*) as n, count(sign) as cut from {{fronts}} group by form),
         classes as (select class, sum(n) as n, sum(cut) as cut from forms group by class)
    select form from forms join classes using (class)
    where if(forms.n >= {ENOUGH}, forms.cut >= {MARKED} * forms.n, classes.cut >= {MARKED} * classes.n)
"""


def judged(audits: DataFrame) -> DataFrame:
    """(audit_id, source, cut, sign): every audit with an analysis once, whether it was cut, and by which sign.

    audits: audit_id, source, analysis; other columns are ignored. Null analyses are left out; empty and blank ones aren't
    cut, and ones without a word are judged by their tails alone. Rows that repeat an audit count once; if they differ in
    their analysis, the audit is cut if any of them is. An empty table gives no rows.
    """
    spark = audits.sparkSession
    view: dict[str, DataFrame] = {}
    sql = lambda query: spark.sql(query, **view)
    rows = audits.select("audit_id", F.trim("source").alias("source"), F.col("analysis").alias("text")).filter("audit_id is not null and text is not null").distinct()
    closed = F.rtrim("text")
    tail = F.when(F.right(closed, F.lit(1)).isin(*TAIL_ENDS) | F.endswith(closed, F.lit("..")), F.nullif(F.regexp_extract("text", TAIL, 0), F.lit("")))
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("tail"), r"\s+", ""), r"\p{N}+", "0"), r"([.…\x{FFFD}])\1*", "$1")
    kind = F.when(F.col("form").rlike(r"^[.…\x{FFFD}]"), F.col("form")).when(F.contains("form", F.lit("0")), "[0]").otherwise("[]")
    front = F.when(F.col("tail").isNotNull(), F.left("text", F.length("text") - F.length("tail")))
    rows = rows.withColumn("tail", tail).withColumn("front", front).withColumn("form", form)
    rows = _with_tokens(_with_tokens(rows, "text", "w", "p"), "front", "fw", "fp")
    texts = materialize(
        rows.select(F.xxhash64("audit_id", "text").alias("key"), "audit_id", "source", "form", F.when(F.col("form").isNotNull(), kind).alias("class"), "w", "p", "fw", "fp"), "cut-texts"
    )
    bits = _frequent(texts, max(RARE_LEAST, int(RARE_SHARE * texts.count())))
    view["grams"] = _grams(texts, bits)
    view["pairs"] = materialize(sql("select t, b, c, sum(n) as n, sum(e) as e from {grams} group by t, b, c"), "cut-bigrams")
    view["singles"] = sql("select t, c, sum(n) as n, sum(e) as e from {pairs} group by t, c")
    view["longer3"], view["longer2"] = sql(_LONGER % ("a, b", "grams")), sql(_LONGER % ("b", "pairs"))
    four = lambda x: F.split(F.substring_index(x, " ", -4), " ")
    # in front of a tail, a trigram was counted as one at an end only if the tail adds no token or an end mark
    after = F.get(F.split("w", " "), F.size(F.split("fw", " ")))
    whole = texts.filter("w <> ''").select("key", F.lit(0).alias("v"), F.lit(True).alias("own"), "w", "p")
    front = texts.filter("fw <> ''").select("key", F.lit(1).alias("v"), (after.isNull() | _is_end(after)).alias("own"), F.col("fw").alias("w"), F.col("fp").alias("p"))
    bounds = whole.unionByName(front).select("key", "v", "own", F.explode(F.array(F.struct(F.lit("w").alias("t"), F.col("w").alias("x")), F.struct(F.lit("p").alias("t"), F.when(F.col("p") == "", F.col("w")).otherwise(F.col("p")).alias("x")))).alias("y"))
    ends = bounds.select("key", "v", "own", "y.t", F.transform(four("y.x"), _part).alias("x"))
    # a generator, so that the shapes aren't computed again for each condition on them
    view["ends"] = ends.select("key", "t", "v", "own", "x", F.explode(F.array(F.transform("x", lambda x: _shape(x, bits)))).alias("s"))
    view["last"] = materialize(sql(_LAST), "cut-last")
    keys = ["t", "ended", "last", "a", "b", "c", "own"]
    signs = materialize(sql(_EVIDENCE).select(*keys, F.expr(_SIGN).alias("sign")).filter("sign is not null"), "cut-signs")
    found = materialize(skew_join(view["last"], signs, keys).groupBy("key", "v").agg(F.min("sign").alias("sign")), "cut-found")
    view["fronts"] = materialize(texts.filter("form is not null").select("key", "form", "class").join(found.filter("v = 1").select("key", "sign"), "key", "left"), "cut-fronts")
    marked = skew_join(view["fronts"].select("key", "form"), materialize(sql(_MARKS), "cut-marks"), ["form"]).select("key", F.lit("mark").alias("sign"))
    signed = found.filter("v = 0").select("key", "sign").unionByName(marked).groupBy("key").agg(F.max_by("sign", F.col("sign") == "mark").alias("sign"))
    return (
        texts.select("key", "audit_id", "source").join(signed, "key", "left")
        .groupBy("audit_id").agg(F.min("source").alias("source"), F.min("sign").alias("sign"))
        .select("audit_id", "source", F.col("sign").isNotNull().alias("cut"), "sign")
    )


def cut_audits(audits: DataFrame) -> DataFrame:
    """audit_id of each audit whose analysis was cut."""
    return judged(audits).filter("cut").select("audit_id")


def cut_shares(audits: DataFrame) -> DataFrame:
    """Per source: audits, audits with an analysis, cut ones by sign, and the share of cut ones among those with one."""
    every = audits.filter("audit_id is not null").groupBy("audit_id").agg(F.min(F.trim("source")).alias("source"))
    return (
        every.join(judged(audits).drop("source"), "audit_id", "left").groupBy("source").agg(
            F.count("*").alias("n_audits"),
            F.count("cut").alias("n_with_analysis"),
            F.count_if("cut").alias("n_cut"),
            *[F.count_if(F.col("sign") == s).alias("n_" + s.replace("-", "_")) for s in ("mark", "mid-sentence", "mid-word")],
            F.round(F.coalesce(F.try_divide(F.count_if("cut"), F.count("cut")), F.lit(0.0)), 6).alias("share_cut"),
        )
    )
