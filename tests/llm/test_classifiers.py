"""Classifiers on held-out rows of the given tables, and on odd input."""

import math
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabwarden.llm import language, quality, queries, toxicity, urls

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def held(doc_id, parts, rest):
    return zlib.crc32(str(doc_id).encode()) % parts == rest


def test_language_on_held_out_documents(spark, docs):
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = queries.op1(spark, SF).collect()
    assert len(rows) == len(known) and all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out and known[r.doc_id]]
    assert sum(r.lang_pred == known[r.doc_id] for r in out) >= 0.98 * len(out)


def reference_distance(text, profile, size):
    grams = {}
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    for w in words:
        w = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                g = w[i : i + n]
                if g != " ":
                    grams[g] = grams.get(g, 0) + 1
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    top = sorted(grams, key=lambda g: (-grams[g], code(g)))[:size]
    rank = {g: i for i, g in enumerate(profile)}
    return sum(abs(rank[code(g)] - i) if code(g) in rank else size for i, g in enumerate(top)) / (size * len(top))


def test_language_distance_against_the_plain_definition(spark, docs):
    profiles = language.learn_profiles(docs, per_language=20, size=50)
    rows = docs.limit(40).collect()
    out = {r.doc_id: r for r in language.identify(docs.limit(40), profiles, size=50).collect()}
    for r in rows:
        apart = sorted((reference_distance(r.text, profiles[n], 50), n) for n in profiles)
        assert out[r.doc_id].lang_pred == apart[0][1]
        assert abs(out[r.doc_id].score - (apart[1][0] - apart[0][0]) / apart[1][0]) < 1e-9


ODD = [(1, None), (2, ""), (3, "123 !? \n"), (4, "é"), (5, "x" * 200_000), (5, "x" * 200_000), (None, "the of and")]


def odd(spark):
    return spark.createDataFrame([(i, t, "z", 1.0, 3.0) for i, t in ODD], "doc_id bigint, text string, lang_pred string, score double, stat_extra double")


def test_language_of_odd_texts(spark, docs):
    profiles = language.learn_profiles(docs)
    rows = language.identify(odd(spark), profiles).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[None].lang_pred == "en"
    assert {r.lang_pred for r in language.identify(odd(spark), {}).collect()} == {"und"}
    assert language.identify(odd(spark).limit(0), profiles).count() == 0
    assert language.learn_profiles(docs.limit(0)) == {}
    assert set(language.learn_profiles(docs.where("lang = 'fr'"))) == {"fr"}


def measured(rows, labels, column, parts, rest):
    assert all(r.held_out == held(r.doc_id, parts, rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    out = [(getattr(labels[r.doc_id], column), r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    return [sum(p == q == 1 for p, q in out) / max(1, sum(x)) for x in ([p for p, _ in out], [q for _, q in out])]


def test_toxicity_on_held_out_documents(spark):
    """Also outside English. The English misses hold no toxic word at all: their labels are noise."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op2(spark, sf).collect()
    recall, precision = measured(rows, labels, "toxic", 5, 0)
    assert recall >= 0.9 and precision >= 0.95
    other = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang <> 'en'").select("doc_id").collect()}
    recall, precision = measured([r for r in rows if r.doc_id in other], labels, "toxic", 5, 0)
    assert recall >= 0.9 and precision >= 0.9


def test_toxicity_scores_match_a_plain_version(spark, docs):
    """Ratios from documents with and without each n-gram; scores from the weights of the n-grams present."""
    rows = docs.limit(60).collect()
    df = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id bigint, text string")
    model = toxicity.train(df, df.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic"), features=400)
    grams = {}
    for r in rows:
        letters = "".join(c.lower() if c.isalpha() else " " for c in r.text)
        for n in toxicity.ORDERS:
            for i in range(len(letters) - n + 1):
                grams.setdefault(letters[i : i + n], set()).add(r.doc_id)
    of = {}
    for r in rows:
        _, f = toxicity.present(pa.array([r.text]))
        of[r.doc_id] = set(f.tolist())
    assert all(len(of[r.doc_id]) >= 0.95 * sum(r.doc_id in d for d in grams.values()) for r in rows)
    weight = dict(zip(model.buckets, model.weights))
    out = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    for d, f in of.items():
        z = model.bias + sum(weight.get(b, 0.0) for b in f)
        assert out[d] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_quality_on_held_out_documents(spark, labels):
    recall, precision = measured(queries.op3(spark, SF).collect(), labels, "quality", 3, 1)
    assert recall >= 0.95 and precision >= 0.95


def test_classifiers_without_labels_or_text(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    ones = docs.selectExpr("doc_id", "1 as toxic", "1 as quality")
    for labels_, want in ((none, 0), (ones, 1)):
        rows = toxicity.score(odd(spark), toxicity.train(docs, labels_)).collect() + quality.score(odd(spark), quality.train(docs, labels_)).collect()
        assert len(rows) == 2 * len(ODD) and {r.predicted for r in rows} == {want}
    few = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)], "doc_id bigint, toxic int, quality int")
    for module in (toxicity, quality):
        model = module.train(docs, few)
        assert module.score(odd(spark), model).count() == len(ODD)
        assert module.score(odd(spark).limit(0), model).count() == 0


def test_toxicity_weights_are_scaled_by_log_count_ratios(spark):
    words = "plain words number of some kind here".split()
    texts = [(i, " ".join(words[: i % 7] + ["gormless"] * (i % 2) + words[i % 7 :] + [str(i)])) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    model = toxicity.train(df, df.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    new = spark.createDataFrame([(1, "other gormless thing"), (2, "other thing of some kind")], "doc_id bigint, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(new, model).collect()} == {1: 1, 2: 0}


def test_compiled_rules_match_plain_evaluation(spark, docs, labels):
    """Every conjunction by hand, weighted and summed."""
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.rules and all(rule for rule, _ in model.rules)
    table = quality.with_statistics(docs.limit(100)).collect()
    out = {r.doc_id: r.score for r in quality.score(docs.limit(100), model).collect()}
    for r in table:
        z = model.bias + sum(w for rule, w in model.rules if all(r[name] > cut if greater else r[name] <= cut for name, greater, cut in rule))
        assert out[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


CLASHES = "rid long, _text string, _spans string, _id long, score double, predicted int, lang_pred string, none int, row string, stat_chars double, label double, node long, id long, `odd name` array<struct<a:int>>"


def test_kept_columns_that_clash(spark, docs):
    """A result wins over a kept column of its name; all others come through."""
    profiles, labels_ = language.learn_profiles(docs), spark.read.parquet(f"{SF}/labels.parquet")
    values = [(1, "the of and to in", 7, "t", "s", 8, 0.5, 9, "zz", 3, "r", 4.0, 1.0, 5, 6, [(1,)])]
    df = spark.createDataFrame(values, "doc_id long, text string, " + CLASHES)
    others = [c for c in df.columns if c not in ("score", "predicted", "lang_pred")]
    want = df.select(*[f"`{c}`" for c in others]).collect()
    for out, made in ((language.identify(df, profiles, keep=df.columns), {"lang_pred", "score"}), (quality.score(df, quality.train(docs, labels_), keep=df.columns), {"score", "predicted"}), (toxicity.score(df, toxicity.Model([], [], 0.0), keep=df.columns), {"score", "predicted"})):
        assert len(out.columns) == len(set(out.columns)) and set(out.columns) == set(df.columns) and made <= set(out.columns)
        assert out.select(*[f"`{c}`" for c in others]).collect() == want
        assert 0 <= out.first().score <= 1


def test_statistics_of_chosen_texts():
    rows = quality.statistics_of(pa.array(["Ab c1!\né b b", None, "", "x"], pa.string()))
    by = dict(zip(quality.STATISTICS, rows[0]))
    assert by["stat_chars"] == 12 and by["stat_words"] == 5 and by["stat_lines"] == 2 and by["stat_longest_word"] == 3
    assert by["stat_upper"] == by["stat_digits"] == by["stat_shouts"] == by["stat_beyond_ascii"] == pytest.approx(1 / 12)
    assert by["stat_distinct_words"] == pytest.approx(4 / 5) and by["stat_top_word"] == pytest.approx(2 / 5) and by["stat_repeated_neighbours"] == pytest.approx(1 / 5)
    assert rows[1].tolist() == rows[2].tolist() and rows[2][0] == 0


def test_rules_are_paths_of_the_trees():
    debug = """RandomForest
  Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 1 > 1.0)
      Predict: 0.0
     Else (feature 1 <= 1.0)
      Predict: 1.0
    Else (feature 0 > 2.5)
     Predict: 1.0
"""
    paths = quality.tree_paths(debug, ("a", "b"))
    first = ("a", False, 2.5)
    assert paths == [(first,), (first, ("b", True, 1.0)), (first, ("b", False, 1.0)), (("a", True, 2.5),)]


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len) if fits else None


URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "https://a.example.com/en/1", "https://example.net/es/", "ftp://x.net/fr", "a://b://c/d", "http://É.net/es/é?x", "http://x.org?q=/en/", "http://x.org#/a", "http://" + "a." * 20_000 + "net/fr/" + "b/" * 20_000]


def test_urls_against_the_rules(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    rows = [(r.page_id, r.url) for r in pages] + [(10_000 + i, u) for i, u in enumerate(URLS)] * 2
    df = spark.createDataFrame([(i, u, "h", 1.0) for i, u in rows], "page_id bigint, url string, host string, label double")
    out = urls.judge(df, queries.URL_RULES).collect()
    assert len(out) == len(rows)
    given = dict(rows)
    for r in out:
        host, path, rule = plain_verdict(given[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == queries.URL_RULES[rule])


def plain_features(url, host, path):
    url = url or ""
    query = url.split("#")[0].split("?", 1)[1] if "?" in url.split("#")[0] else ""
    share = [url.count(c) / len(url) for c in set(url)]
    return {
        "length": len(url), "host_length": len(host), "host_parts": len(host.split(".")), "depth": path.count("/"), "digit_share": sum(c in "0123456789" for c in url) / max(len(url), 1),
        "entropy": -sum(p * math.log2(p) for p in share), "parameters": query.count("&") + 1 if query else 0, "value_length": len(query), "hyphens": url.count("-") + url.count("_"),
        "encoded": url.count("%"), "fragment": float("#" in url), "secure": float(url.startswith("https://")), "suffix": host.split(".")[-1],
    }


def test_url_features_match_a_plain_version(spark):
    pages = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").limit(200).collect()] + URLS
    base = spark.createDataFrame([(u,) for u in pages], "url string").withColumns({"host": urls.host_of(F.col("url")), "path": urls.path_of(F.col("url"))})
    for r in urls.lexical(base).collect():
        want = plain_features(r.url, *plain_verdict(r.url)[:2])
        assert {k: r[k] for k in want} == {k: pytest.approx(v) if k != "suffix" else v for k, v in want.items()}


def test_training_sees_a_suffix_only_through_other_folds_and_hidden(spark):
    rows = [(f"http://h{i}.{s}/{i}", s, float(s == "net" or (s == "mix" and i % 2))) for i in range(200) for s in ("com", "net", "mix")]
    base = spark.createDataFrame(rows, "url string, suffix string, label double")
    features = [c for c in urls.FEATURES if not c.startswith("suffix")]
    drawn = base.select("*", *(F.lit(0.0).alias(c) for c in features))
    folds = base.groupBy("suffix", urls._fold("url").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("known"), F.sum("label").alias("bad"))
    stats = folds.groupBy("suffix").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"), (F.sum("n") / 600).alias("share"))
    out = urls.training_rows(drawn, folds, stats, 0.5)
    shown, hidden = out.where("suffix_known = 1").collect(), out.where("suffix_known = 0").collect()
    assert len(shown) == len(hidden) == len(rows) and {(r.suffix_share, r.suffix_blocked) for r in hidden} == {(0.0, 0.5)}
    fold = {r.url: r.f for r in base.select("url", urls._fold("url").alias("f")).collect()}
    want = []
    for u, s, y in rows:
        other = [z for v, t, z in rows if t == s and fold[v] != fold[u]]
        want.append((y, (sum(other) + 5) / (len(other) + 10)))
    got = sorted((r.label, r.suffix_blocked) for r in shown)
    assert [x for pair in got for x in pair] == pytest.approx([x for pair in sorted(want) for x in pair])


def test_verdicts_depend_on_more_than_the_suffix(spark):
    """Both verdicts occur among undecided pages of one suffix, and other features change them."""
    sf = "/root/testdata/sf0.1"
    out = queries.op7(spark, sf).where("rule IS NULL and host like '%.org'").groupBy("verdict").count().collect()
    assert {r.verdict for r in out} == {"allow", "block"}


def test_urls_without_anything_to_learn(spark):
    schema = "page_id bigint, url string"
    assert urls.judge(spark.createDataFrame([], schema), queries.URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.org/x"), (2, None)], schema)
    assert {r.verdict for r in urls.judge(one, queries.URL_RULES).collect()} == {"allow"}
    assert {r.verdict for r in urls.judge(one, {"com/": "block"}).collect()} == {"block"}


def test_urls_learn_from_the_rules(spark):
    rows = [(i, f"http://h{i}.com/a") for i in range(60)] + [(100 + i, f"http://h{i}.net/es/{'9' * 20}?a={i}&b=1&c=2") for i in range(60)]
    rows += [(500, "http://new.org/b"), (501, f"http://new.org/es/{'8' * 20}?a=1&b=1&c=3")]
    out = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), queries.URL_RULES).collect()}
    assert (out[500], out[501]) == ("allow", "block")


def test_training_urls_are_distinct_and_bounded(spark):
    """A URL on many pages counts once and does not push the others of its verdict out of the sample."""
    hot = "http://hot.net/es/x"
    rows = [(hot, 1.0)] * 20_000 + [(f"http://h{i}.net/es/{i}", 1.0) for i in range(2_000)] + [(f"http://h{i}.com/{i}", 0.0) for i in range(300)] + [("http://new.org", None)]
    df = spark.createDataFrame(rows, "url string, label double").repartition(4)
    drawn = [tuple(r) for r in urls.bounded_sample(df, 400).collect()]
    assert len(drawn) == len(set(drawn)) == 700 and sum(y for _, y in drawn) == 400
    assert sorted(drawn) == sorted(tuple(r) for r in urls.bounded_sample(df.distinct(), 400).collect())


def test_a_frequent_blocked_url_does_not_hide_the_others(spark):
    """200,000 copies of one blocked URL beside 300 other blocked ones: an undecided URL like those is still blocked."""
    rows = spark.range(300).selectExpr("id", "concat('http://h', id, '.com/a') AS url")
    rows = rows.unionByName(spark.range(300).selectExpr("id + 1000 AS id", "concat('http://k', id, '.net/es/', repeat('9', 20), '?a=', id, '&b=1&c=2') AS url"))
    rows = rows.unionByName(spark.range(200_000).selectExpr("id + 10000 AS id", "'http://hot.net/es/x' AS url"))
    rows = rows.unionByName(spark.createDataFrame([(5000, "http://new.org/b"), (5001, f"http://new.org/es/{'8' * 20}?a=1&b=1&c=3")], "id bigint, url string"))
    out = urls.judge(rows.withColumnRenamed("id", "page_id"), queries.URL_RULES, per_verdict=100).where("page_id in (5000, 5001)")
    assert {r.page_id: r.verdict for r in out.collect()} == {5000: "allow", 5001: "block"}


def test_quality_fits_its_bounded_rows_in_few_tasks(spark, monkeypatch):
    """However many tasks read the documents; each iteration is a job over all partitions of the training rows."""
    seen = []

    def watching(maker):
        class Watching(maker):
            def fit(self, dataset, params=None):
                seen.append((dataset.rdd.getNumPartitions(), dataset.count()))
                return super().fit(dataset, params)

        return Watching

    for name in ("RandomForestClassifier", "LogisticRegression"):
        monkeypatch.setattr(quality, name, watching(getattr(quality, name)))
    rows = [(i, ("good words here " * 5 if i % 2 else "A!! | B?? ") + str(i)) for i in range(300)]
    dealt = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(20)
    labels_ = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    model = quality.train(dealt, labels_)
    assert seen == [(1, 300), (1, 300)]
    assert all(r.predicted == r.doc_id % 2 for r in quality.score(dealt, model).collect())
    seen.clear()
    monkeypatch.setattr(quality, "FIT_ROWS", 100)
    quality.train(dealt, labels_)
    assert seen == [(3, 300), (3, 300)]
