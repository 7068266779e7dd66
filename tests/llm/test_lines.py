"""Quality rules against a plain version."""

import re

import pytest

from conftest import SF
from tabwarden.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPELT = str.maketrans("0123456789", "abcdefghij")


def plain(rows, most, least=50):
    """{row number: (counts, base_failed, kept, removed words, text without frequent lines)}"""
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c for c in s)
    norm = lambda line: " ".join(lower(w) for w in WORD.findall(line))
    seen = {}
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            if norm(line):
                seen.setdefault((host or "", norm(line)), set()).add(text or "")
    out = []
    for i, text, host in rows:
        text, host = text or "", host or ""
        words = WORD.findall(text)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times = {}
        for g in grams:
            times[g] = times.get(g, 0) + 1
        repeated = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}
        full = [x for x in text.split("\n") if norm(x)]
        gone = lambda line: len(seen.get((host, norm(line)), ())) > most  # noqa: E731, B023
        removed = sum(len(WORD.findall(x)) for x in full if gone(x))
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        kept = not failed and 100 * (len(words) - removed) >= least * len(words)
        counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(repeated))
        out.append((i, *counts, failed, kept, removed, "\n".join(x for x in text.split("\n") if not gone(x))))
    return out


def sentence(k, n=12):
    return " ".join(f"w{k}x{j}é".translate(SPELT) for j in range(n))


def rows():
    out = []
    for k in range(30):
        own = [sentence(100 * k + j) for j in range(6)]
        shared = ["Share this | page NO %d" % (k % 7), "  the same   line\there "] if k % 2 else []
        out.append((k, "\n".join(shared + own), "hot" if k < 20 else "cold"))
    out += [(200 + k, "\n".join(["all of this is", sentence(6_000, 20), "without any", sentence(k, 3), sentence(7_000, 40)]), "hot") for k in range(8)]
    out += [(300, "\n".join(sentence(900 + j) for j in range(6)), "hot")] * 9
    out += [(400, None, None), (401, "", "hot"), (402, "\n\n \t\n", None), (403, "a b c a b c", "hot"), (403, "a b c a b c", "hot"), (None, "x y", None), (404, "#" * 70 + " <|>", ""), (405, "w " * 60_000, "long")]
    out += [(406, "a\r\nb\x0bc\x0cd\na\r\nb", "cold"), (407, "ünï cödé 日本語  x y", "cold")]
    return out


def frame(spark, data):
    df = spark.createDataFrame([(i, t, h, 1, 2, 3, "z") for i, t, h in data], "doc_id bigint, text string, source string, rid int, host int, n_words int, row string")
    return df.repartition(4)


@pytest.mark.parametrize("broadcast", [0, 1_000])
def test_rules_match_the_plain_version(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lines, "BROADCAST_LINES", broadcast)
    data = rows()
    out = lines.judge(frame(spark, data), most_documents=5).collect()
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in out), key=key) == sorted((r[:-1] for r in plain(data, 5)), key=key)
    by = {r.doc_id: r for r in out}
    assert by[200].removed_words > 0 and not by[200].base_failed and not by[200].kept and by[300].kept


def test_cleaned_texts_lack_frequent_lines_only(spark):
    data = rows()
    df = frame(spark, data)
    out = lines.cleaned(df, most_documents=5)
    assert out.columns == df.columns
    want = sorted((r[0], r[-1]) for r in plain(data, 5) if r[7])
    assert sorted((r.doc_id, r.text) for r in out.collect()) == want
    assert all((r.rid, r.host, r.n_words, r.row) == (1, 2, 3, "z") for r in out.collect())


def test_given_documents_and_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = sorted(tuple(r) for r in lines.judge(docs, most_documents=2).collect())
    assert got == sorted(r[:-1] for r in plain(data, 2)) and any(r[-1] for r in got)
    assert lines.judge(docs.limit(0)).count() == 0 and lines.cleaned(docs.limit(0)).count() == 0


def test_a_line_in_every_document_is_counted_in_many_tasks(spark):
    """No task of the count reads more than its share, though one line is in each of 6,000 documents of one host."""
    texts = spark.range(6_000).selectExpr("id AS doc_id", "concat('one line for all', '\n', repeat(concat('w', id, ' '), 3)) AS text", "'hot' AS source").repartition(8)
    measured = lines._measured(texts.selectExpr("text", "source AS host"))
    seen = measured.selectExpr("host", "explode(lines) AS line", "text_hash").distinct()
    sizes = [r["count"] for r in seen.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    assert sum(sizes) == 12_000 and max(sizes) < 2 * 12_000 / len(sizes)
    assert lines.frequent_lines(measured).count() == 4  # that line, and those of numbers of two, three and four digits
