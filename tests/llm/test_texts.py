import random
import re

import pytest
from pyspark.sql import functions as F

from veritrace.llm import encode, leakage, residue, truncation

TOKENIZERS = encode.TOKENIZERS
EXTRA = ["", None, " ", "   \n\n x", "=" * 3000, "a" * 997, "<|endoftext|> it's WE'LL", "é表单🦊‍\x1c\x00￾", "１２３½², ٣", "\t\r\n 　  x  ", "don't'll ''s", "x" * 20 + "🇦🇶" * 30]


def texts(spark, sf, n=None):
    rows = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    return (rows if n is None else rows[:n]) + EXTRA


def test_ids_as_the_tokenizer(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    many = texts(spark, sf)
    df = spark.createDataFrame([(i, x, 1, "w") for i, x in enumerate(many)], "doc_id long, text string, ids int, word string")
    got = {r.doc_id: r.ids for r in encode.encode_corpus(df).collect()}
    for i, x in enumerate(many):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else []), repr(x)[:80]
        assert encode.decode(got[i]) == (x or "")


def test_tokens_are_their_own_encoding():
    e = encode.Encoder()
    words = [(t, i) for t, i in e.ids.items() if len(t) > 1][::25]
    sizes, ids = e._contract([t for t, _ in words])
    assert (sizes == 1).all() and ids.tolist() == [i for _, i in words]


def test_encoder_forgets_and_splits(monkeypatch):
    monkeypatch.setattr(encode, "KEPT_WORDS", 3)
    monkeypatch.setattr(encode, "QUERY_BYTES", 20)
    e, f = encode.Encoder(), encode.encoder(TOKENIZERS, "byte_bpe_50k")
    for k in range(4):
        x = [f"zelmorvat{k} quibberish{j} " * 3 for j in range(5)]
        assert e.encode(x).to_pylist() == f.encode(x).to_pylist()


PASSAGES = [(1, " ".join(f"w{k}" for k in range(30))), (2, " ".join(f"w{k}" for k in range(10, 25))), (3, "too short"), (4, None), (5, ""), (6, "A b " * 15)]


def brute(docs, least=12):
    word = re.compile(r"[^\W_]+")
    out = set()
    for d, text in docs:
        have = f" {' '.join(w.casefold() for w in word.findall(text or ''))} "
        for i, p in PASSAGES:
            w = [x.casefold() for x in word.findall(p or "")]
            out |= {(d, i) for k in range(len(w) - least + 1) if f" {' '.join(w[k : k + least])} " in have}
    return out


def test_leaks(spark):
    rng = random.Random(4)
    docs = [(1, "x; " + ", ".join(f"W{k}" for k in range(3, 15)) + " end"), (2, " ".join(f"w{k}" for k in range(3, 14))), (3, None), (4, ""), (5, "a B! " * 40), (6, PASSAGES[0][1]), (6, PASSAGES[0][1]), (7, " ".join(f"w{k}" for k in range(9, 26)) + " . " + " ".join(f"w{k}" for k in range(0, 13)))]
    docs += [(100 + k, " ".join(f"w{rng.randrange(12)}" for _ in range(50))) for k in range(20)]
    d = spark.createDataFrame([(i, t, 9, "s") for i, t in docs], "doc_id long, text string, item_id int, source string")
    p = spark.createDataFrame([(i, t, 7) for i, t in PASSAGES], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in leakage.leaked_pairs(d, p).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs)
    texts_ = dict(docs)
    for r in leakage.leaked_spans(d, p).collect():
        cut = texts_[r.doc_id][r.first_char : r.end_char]
        assert len(leakage._WORD.findall(cut)) == r.words >= 12 and cut[0].isalnum() and cut[-1].isalnum()
    items = {r.item_id: r for r in leakage.leaked_items(d, p).collect()}
    assert items[1].whole and items[1].longest == 30 and not items[3].n_docs and items[4].n_words == 0
    assert leakage.leaked_pairs(d.limit(0), p).count() == leakage.leaked_pairs(d, p.limit(0)).count() == 0


def test_leak_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 25)
    d = spark.createDataFrame([(1, PASSAGES[0][1]), (5, "a b " * 9)], "doc_id long, text string")
    p = spark.createDataFrame(PASSAGES, "item_id long, text string")
    assert leakage._blocks(p)[1] > 2
    assert {tuple(r) for r in leakage.leaked_pairs(d, p).collect()} == {(1, 1), (1, 2), (5, 6)}
    assert leakage.leaked_pairs(d.limit(0), p).count() == 0


def audits(spark):
    rng = random.Random(1)
    names = [f"{a}{b}{c}" for a in ("zel", "mor", "qua") for b in ("ba", "ri", "tun") for c in ("lk", "nd", "sh", "rt")]
    rows, i = [], 0

    def sentence():
        n, p = rng.choice(names), f"/srv/{rng.choice(names)}/{rng.choice(names)[:4]}_{rng.randrange(999)}.json"
        return rng.choice((f"The agent copied {p} without asking.", f"Because the sandbox had no outbound route, {n} asked for confirmation and stopped.", f"The effect is limited to {p}.", "No dangerous step was completed."))

    for _ in range(700):
        rows.append((i := i + 1, "s", " ".join(sentence() for _ in range(3))))
    return rows


def test_cut_texts(spark):
    rows = audits(spark)
    whole = ["The agent copied /srv/zelbalk/mor_1.json without asking", "No dangerous step was completed", "Done. The effect is limited to /srv/zelbalk/morb_12.json", "", "  ", "12", None]
    cut = ["The agent copied /srv/zelbalk/morb_12.json with", "Because the sand", "Because the sandbox had no", "No dangerous step was [truncated]", "No dangerous step w...", "The agent asked for confirm", "No dangerous step was completed. <snip>", "The eff�"]
    more = [(10_000 + k, " s ", t) for k, t in enumerate(whole)] + [(20_000 + k, "t", t) for k, t in enumerate(cut)]
    more += [(20_000, "t", cut[0]), (None, "t", cut[0])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows + more], "audit_id long, source string, analysis string, key int, n int, text string")
    out = {r.audit_id: r for r in truncation.judged(df).collect()}
    assert len(out) == len(rows) + len(whole) - 1 + len(cut)
    assert not [r for r in out.values() if r.cut and r.audit_id < 20_000]
    assert sorted(r.audit_id for r in truncation.cut_audits(df).collect()) == [20_000 + k for k in range(len(cut))]
    shares = {r.source: r for r in truncation.cut_shares(df).collect()}
    assert shares["t"].share_cut == 1 and shares["t"].n_cut == len(cut) and shares["s"].n_with_analysis == len(rows) + len(whole) - 1
    assert truncation.cut_audits(df.limit(0)).count() == 0


def test_long_runs_of_signs(spark):
    rows = [(k, "s", t) for k, t in enumerate(("a" + "_" * 40_000, "a" + "_-" * 20_000 + ".", "/" * 40_000, "x." * 20_000, "." * 40_000, "word " * 40_000, "[" * 40_000, "=" * 40_000 + " …"))]
    df = spark.createDataFrame(rows, "audit_id long, source string, analysis string")
    assert {r.audit_id for r in truncation.judged(df).collect()} == set(range(len(rows)))


def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_residue(spark, sf):
    base = corpus(spark, "/root/testdata/sf0.01").select("doc_id", "source", "text")
    bad = ["404 Not Found\nThe requested page could not be located on this server.", "Please enable JavaScript to view this trace.", "Dear {{ first_name }}, please confirm that {{ account }} may be shared with Zelmor.", "TBD TBD TBD"]
    good = ["", "  ", "########", "<|endoftext|><s>", "The tool answered 502 Bad Gateway for zelmor-1.test, so the agent tried the mirror and finished AUD-49222.", "Command: export OUT=${HOME}/zel && cp /srv/a.json \"$OUT\"", "Zelmor asked the build runner to hash the route table and send the result to xan-20.invalid."]
    rows = [(10**6 + k, "new", t) for k, t in enumerate(bad)] + [(2 * 10**6 + k, None, t) for k, t in enumerate([*good, None])]
    df = base.unionByName(spark.createDataFrame(rows, base.schema)).withColumns({"kind": F.lit(1), "maybe": F.lit(2), "o": F.lit(3)})
    found = {r.doc_id for r in residue.residue_documents(df).collect()}
    assert {i for i, _, _ in rows} & found == {10**6 + k for k in range(len(bad))}
    v = {r.withheld: r for r in residue.validation(df).collect()}
    assert set(v) == {"", *residue.CUES, *residue.SLOTS}
    assert v[""].recall > 0.9 and v[""].precision > 0.8 and v[""].n_content > 100
    n = residue.residue_report(df).agg(F.sum("n_docs"), F.sum("n_kept")).first()
    assert n[0] == df.count() and n[1] == n[0] - len(found)


def test_residue_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert residue.residue_documents(empty).count() == 0 and residue.validation(empty).first().precision is None
    one = spark.createDataFrame([(1, "a", "Plain words only."), (1, "a", "Plain words only.")], "doc_id long, source string, text string")
    assert residue.residue_documents(one).count() == 0


@pytest.mark.parametrize("text, n", [("{{x}} ${y} %(z)s __A_B__ @@c@@ <<d>> [[e]] «f g» $$h$$ {% i %} <%= j %> #{k} (fill in l) <user name> [INSERT IT] {due_date} %TITLE%", 17), ("<s> <html> a[1] {1} 5% off {} [] f\"{name}\" ____________", 0)])
def test_slots(text, n):
    assert len(residue.SLOT.findall(text)) == n


def sample(folder):
    import duckdb

    return duckdb.sql(f"select source, text from '{folder}/documents.parquet' where length(text) between 1 and 20000 order by hash(doc_id)").fetchall()


FORMS = ["Dear {{X}}, please confirm that {{Y}} may be shared with Zelmor.", "Hola <X>, el caso <Y> fue asignado.", "Session 【X】 was started by 【Y】.", "尊敬的{{{{X}}}}，工单{{{{Y}}}}已转交。", "Dear ~~X~~, your audit of ~~Y~~ ended.", "Dear ‹X›, your audit of ‹Y› ended."]


def test_slots_in_spellings_without_labels():
    """No spelling here is in SLOTS: found by shape and by what was learned from others."""
    scorer = residue.Scorer(residue.fit(sample("/root/testdata/sf0.01"))[0])
    cases = [f.replace("{{{{", "\0").replace("}}}}", "\1").replace("{{", "{").replace("}}", "}").replace("\0", "{{").replace("\1", "}}").replace("X", a).replace("Y", b) for f in FORMS for a, b in (("FIRST_NAME", "ORDER_REF"), ("FirstName", "OrderRef"), ("Customer Name", "Run Date"), ("姓名", "日期"))]
    found = [residue.judge(t, scorer) == "slot" for t in cases]
    assert sum(found) >= 0.9 * len(found), [t for t, x in zip(cases, found) if not x]
    content = ["See f(x) and a[i] for the table (compare REQ-1).", "The agent wrote {name} into the `template` file and <user name> is forbidden by the style guide."]
    assert not any(residue.judge(t, scorer) == "slot" for t in content)


@pytest.mark.parametrize("family", sorted(residue.SLOTS))
def test_slots_of_a_withheld_family(family):
    """Trained without any document that has the family, the documents that have it are found as slots where weak labels say so."""
    rows = sample("/root/testdata/sf0.1")[:4000]
    scorer = residue.Scorer(residue.fit(rows, withheld=family)[0])
    want = [t for _, t in rows if residue._SLOTS[family].search(t) and residue.weak_kind(t)[0] == "slot"]
    assert sum(residue.judge(t, scorer) == "slot" for t in want) >= 0.9 * len(want)
