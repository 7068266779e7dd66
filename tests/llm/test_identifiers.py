"""Personal data against the plain patterns, and what the bootstrap adds."""

import hashlib
import random
import re

from conftest import SF
from tabwarden.llm import identifiers

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, found):
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if holds(kind, m[0])]
    spans.sort()
    counts = tuple(sum(s[3] == k for s in spans) for k in BASE)
    listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return counts, hashlib.sha256(listed.encode()).hexdigest(), listed


def check(spark, texts):
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, start int, kind string")
    for r in identifiers.find(df).collect():
        counts, digest, listed = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == counts, texts[r.doc_id][:200]
        assert r.base_sha256 == digest
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_random_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(alphabet) for _ in range(80)) for alphabet in ("a1.@", "12. ", "0123456789 -", "+1 ()2.-", "aé@.1+-_% \n", "a.@b-") for _ in range(120)]
    check(spark, texts)


def test_chosen_and_given_texts(spark):
    chosen = [
        None, "", "nothing", "a@b.c_x@y.z", "a@b", "a@b.c..d@e.f", "é x@y.de 1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.0.00.001", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485 +49 30.123", "++1 2345 67890-",
        "x" * 3_000, "1" * 3_000, "a@" + "b." * 1_000 + "c", "+1" + " " * 3_000, "1-" * 2_000, "mail:me@x.org,ip=10.0.0.1;",
    ]
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, chosen + docs)


def test_long_runs_take_linear_time(spark):
    """The plain patterns need hours for some of these."""
    n = 300_000
    texts = ["x" * n, "1" * n, "a@" + "b." * n + "c", "+1" + " " * n, "1-" * n, "." * n + "1", "+1(" * n, "a1" * n + "@"]
    out = {r.doc_id: r for r in identifiers.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [out[i].n_email for i in range(8)] == [0, 0, 1, 0, 0, 0, 0, 0]
    assert out[2].spans == f"email:0:{2 * n + 3}" and sum(out[i].n_ip + out[i].n_card + out[i].n_phone for i in out) == 0


def test_bootstrap_finds_what_stands_in_the_same_place(spark):
    rng = random.Random(5)
    rows = [f"some words and call {'+1 (%d) 555-%04d' % (rng.randint(200, 999), rng.randint(0, 9999))} again" for _ in range(60)]
    rows += [f"reach us, mail: user{rng.randint(1, 10**6)}@host{i}.org today" for i in range(60)]
    rows += ["please call 555-0199-22 now", "mail: someone@localhost please", "the year 20240101 was long", "version 20240101 of it"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    out = {r.doc_id: r for r in identifiers.find(df).collect()}
    assert out[120].spans == "phone:12:23" and out[120].n_phone == 0 and out[120].n_found == 1
    assert out[121].spans == "email:6:23"
    assert out[122].spans == out[123].spans == ""
    clean = {r.doc_id: r.text for r in identifiers.redact(df).collect()}
    assert clean[120] == "please call [PHONE] now" and clean[121] == "mail: [EMAIL] please" and clean[122] == rows[122]
    assert clean[0] == "some words and call [PHONE] again"


def test_redaction(spark):
    texts = ["a@b.cd 1.2.3.4 x", None, "", "é 4111 1111 1111 1111.", "plain", "+4111111111111111", "1.2.3.4"]
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint")
    out = {r.doc_id: (r.text, r.n_chars) for r in identifiers.redact(df, "text", "n_chars").collect()}
    assert out == {0: ("[EMAIL] [IP] x", 14), 1: (None, -1), 2: ("", -1), 3: ("é [CARD].", 9), 4: ("plain", -1), 5: ("+[CARD]", 7), 6: ("[IP]", 4)}


def test_no_rows_and_repeated_rows(spark):
    schema = "doc_id bigint, text string"
    assert identifiers.find(spark.createDataFrame([], schema)).count() == 0
    assert identifiers.redact(spark.createDataFrame([], schema)).count() == 0
    out = identifiers.find(spark.createDataFrame([(1, "a@b.cd")] * 3 + [(None, "1.2.3.4")], schema)).collect()
    assert sorted((r.doc_id or 0, r.spans) for r in out) == [(0, "ip:0:7")] + [(1, "email:0:6")] * 3


def test_no_python_in_the_plan(spark):
    plan = identifiers.find(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
