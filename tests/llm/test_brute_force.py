"""Corpus operators and the pipeline against plain versions of what they compute."""

import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequill.llm import decontaminate, langid, quality, queries, secrets, simhash
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_llm import WORDS, brute_components, docs, plain_fingerprint, prose

DATA = "/root/testdata/sf0.01"


def test_attention_equals_plain_sums():
    r = np.random.default_rng(4)
    model = quality.train([r.normal(size=(r.integers(1, 6), quality.N_FEATURES)).astype(np.float32) for _ in range(30)], r.integers(0, 2, 30).astype(float), np.ones(30), rounds=20)
    for text in ("", "one", "a b c. " * 100, prose(1, 333) + "\nX|Y!! é"):
        w, x = model.w, np.clip((quality.passages(text) - model.mean) / model.scale, -8, 8)
        assert len(x) == max(-(-len(text.split()) // quality.PASSAGE_WORDS), 1)
        h = [np.tanh(row @ w["We"] + w["be"]) for row in x]
        e = [float((np.tanh(k @ w["V"]) / (1 + np.exp(-(k @ w["U"])))) @ w["a"]) for k in h]
        share = [np.exp(v) / sum(map(np.exp, e)) for v in e]
        logit = sum(p * k for p, k in zip(share, h, strict=True)) @ w["c"] + w["b"][0]
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-4)


def test_training_follows_the_gradient():
    r = np.random.default_rng(2)
    bags = [r.normal(size=(r.integers(1, 5), quality.N_FEATURES)).astype(np.float32) for _ in range(120)]
    labels = np.array([float(b[:, 3].max() > 0.8) for b in bags])

    def loss(rounds):
        model = quality.train(bags, labels, np.ones(len(bags)), rounds=rounds)
        x = [np.clip((b - model.mean) / model.scale, -8, 8) for b in bags]
        z = np.array([quality._forward(model.w, b, np.array([0]), np.zeros(len(b), np.int64))[0][0] for b in x])
        return float(np.mean(np.log1p(np.exp(-np.where(labels == 1, z, -z)))))

    assert loss(200) < 0.3 * loss(1)


def test_quality_held_out_accuracy(spark):
    out = queries.op1_quality_classifier(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    got = out.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right")).first()
    assert got["right"] > 0.95
    everything = queries.op1_quality_classifier(spark, DATA)
    assert everything.count() == spark.read.parquet(f"{DATA}/documents.parquet").count() and everything.where("score < 0 or score > 1 or score is null").count() == 0


def test_quality_odd_rows(spark):
    same = docs(spark, *[prose(i, 90) for i in range(30)], *["buy || now !! " * 20 for _ in range(30)])
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)] + [(None, 1), (3, None), (999, 0)], "doc_id long, quality int")
    model = quality.fit(same.unionByName(same).unionByName(docs(spark, None, "", first=None or 500)), labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(same, model).collect()}
    assert all((got[i] > 0.5) == (i < 30) for i in range(60))
    assert quality.score(docs(spark, None, "", "x " * 200_000), model).count() == 3
    assert quality.score(same.limit(0), model).count() == 0 and quality.accepted(same, model).columns == same.columns
    assert quality.fit(same, labels.limit(0)).score("any") == 1.0


def plain_spans(text):
    """Base spans by Python's re, in the order of the digest."""
    out = []
    for rank, (kind, pattern, ok) in enumerate((("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32))):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if ok(m)]
    return [(a, kind, z) for a, _, kind, z in sorted(out)]


def test_base_spans_equal_plain_search(spark):
    r = random.Random(11)
    bits = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", "x", "é", "\U0001f600", "\n", "a.b-c_d/e+f=", "\t"]
    texts = ["".join(r.choices(bits, k=r.randint(1, 25))) for _ in range(400)] + ["token=" + "a" * 50_000 + " " + "ab" * 30_000]
    rows = docs(spark, *texts, None, "")
    rows = rows.unionByName(rows.limit(20)).unionByName(spark.createDataFrame([(None, "secret: abcdefgh1", "", "", "")], rows.schema))
    for x in secrets.scan_secrets(rows).collect():
        text = "secret: abcdefgh1" if x["doc_id"] is None else (texts[x["doc_id"]] if x["doc_id"] < len(texts) else "")
        assert [(s["start"], s["kind"], s["stop"]) for s in x["spans"] if s["kind"] != "random"] == plain_spans(text)


def test_random_tokens_are_found_from_20_characters(spark):
    r = random.Random(12)
    abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    plain = "getHttpResponseCodeFromServer en/12/ab-cd/2024-01-02/page-3 IPv4/IPv6/H264/MP3/x264 thisIsAVeryLongIdentifierName SOME_CONSTANT_NAME_2 internationalization-localization"
    sizes = [20, 24, 32, 64]
    tokens = ["".join(r.choices(abc, k=sizes[i % 4])) for i in range(400)]
    got = secrets.scan_secrets(docs(spark, *[f"{prose(i, 20)} {t} {plain}" for i, t in enumerate(tokens)])).collect()
    spans = {x["doc_id"]: [(s["start"], s["stop"]) for s in x["spans"]] for x in got}
    at = [len(prose(i, 20)) + 1 for i in range(400)]
    for k in range(4):
        assert np.mean([(at[i], at[i] + sizes[k]) in spans[i] for i in range(k, 400, 4)]) >= 0.9
    assert all(s == (at[i], at[i] + len(tokens[i])) for i, own in spans.items() for s in own)


def test_language_equals_plain_cosines(spark):
    r = random.Random(5)
    words = {"aa": [f"za{k}".replace("1", "q").replace("2", "w") for k in range(40)], "bb": ["".join(r.choices("bcdfgeiou", k=5)) for _ in range(40)]}
    rows = [(i, " ".join(r.choices(words["aa" if i % 2 else "bb"], k=30)), "aa" if i % 2 else "bb") for i in range(80)] + [(None, None, "aa"), (81, "", None), (82, "123", "bb"), (1, "repeated é", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert set(model.langs) == {"aa", "bb"}
    for x in langid.predict(df, model).collect():
        text = next(t for i, t, _ in rows if i == x["doc_id"] and (i != 1 or True))
        counts = langid.ngram_counts(text)
        if x["doc_id"] == 1:
            continue
        if counts is None:
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
            continue
        v = [(1 + np.log(n)) * w if n else 0.0 for n, w in zip(counts, model.idf, strict=True)]
        size = sum(a * a for a in v) ** 0.5
        cos = [sum(a * b for a, b in zip(v, c, strict=True)) / size for c in model.centroids.tolist()]
        best = int(np.argmax(cos))
        assert x["lang_pred"] == model.langs[best] and x["score"] == pytest.approx(cos[best], abs=1e-4)
    assert langid.predict(df.limit(0), model).count() == 0


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(21)
    lines = [" ".join(r.choices(WORDS, k=r.choice([4, 12, 30]))) for _ in range(60)]
    items = [prose(900 + i, 30) for i in range(3)]
    texts = ["\n".join(r.choices(lines, k=r.randint(1, 4))) + "\n" + prose(1000 + i, 120) for i in range(60)]
    texts += [texts[3], texts[4] + " w1", f"{prose(1, 50)}\n{items[1]}\n{prose(2, 50)}", "\n".join(lines[:3]), "$$ || !! 1 1 1 " * 40, None, "", "é " * 9]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(not (t or "").startswith("$$"))) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(p["doc_id"], []).append((p["start"], bytes(p["ids"])))

    # A hash of ids chooses the labelled documents that the plain version learns from, too.
    kept = corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    now = [(x["doc_id"], x["text"]) for x in kept.collect()]
    assert 50 < len(now) <= len(texts)
    gone = brute_lines(now)
    now = [(i, t if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone[i])) for i, t in now]
    root = brute_components({i: plain_fingerprint(t) for i, t in now}, 3)
    now = [(i, t) for i, t in now if root[i] == i]
    clean = lambda t: all(decontaminate.align(decontaminate.words_of(x), decontaminate.words_of(t or ""))[0] < decontaminate.MIN_SCORE for x in items)
    now = [(i, t) for i, t in now if clean(t)]
    encode = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {i: np.array([*encode.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in now}
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in got.items()} == want
    assert os.path.isdir(f"{tmp_path}/documents.parquet") and simhash is not None


def plain_battery(token):
    """The statistics of one token, letter by letter: (encoding, z of uniformity, runs, serial correlation, p of writing)."""
    t = token.rstrip("=")
    name = next((k for k, abc in secrets.ALPHABETS.items() if set(t) <= set(abc)), "mixed")
    abc = secrets.ALPHABETS[name]
    n, k, at = len(t), len(abc), [abc.index(c) for c in t]
    counts = [t.count(c) for c in abc]
    chi2 = sum((c - n / k) ** 2 / (n / k) for c in counts)
    z_chi2 = (chi2 - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    high = [x >= k / 2 for x in at]
    both, runs = 2 * sum(high) * (n - sum(high)), 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    var = both * (both - n) / (n * n * (n - 1))
    z_runs = (runs - 1 - both / n) / math.sqrt(var) if var > 0 else 99.0
    mean = sum(at) / n
    ss = sum((x - mean) ** 2 for x in at)
    z_serial = sum((a - mean) * (b - mean) for a, b in zip(at, at[1:], strict=False)) / ss * math.sqrt(n) if ss > 0 else 99.0
    excess = (n - 1) * (k * max(secrets.WRITING_REPEAT, 1.6 / k) - 1)
    parts = [(excess / math.sqrt(2 * (k - 1) + 4 * excess), (k - 1 + excess - chi2) / math.sqrt(2 * (k - 1) + 4 * excess))]
    kind = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "-" for c in t]
    pairs = [(a, b) for a, b in zip(kind, kind[1:], strict=False) if "-" not in (a, b)]
    digits, letters, capitals = (sum(map(f, abc)) / k for f in (str.isdigit, str.isalpha, str.isupper))

    def over(found, null, of):
        return (found - of * null) / math.sqrt(of * null * (1 - null)) if of else 0.0

    small = sum(map(str.islower, abc)) / k
    parts.append((over(len(pairs) * 2 * digits * letters, secrets.WRITING_DIGIT, len(pairs)), over(sum((a == "d") != (b == "d") for a, b in pairs), secrets.WRITING_DIGIT, len(pairs))))
    if capitals and small and "l" in kind:
        behind = ["".join(kind[i + 1 : i + 3]) for i in range(n - 2) if kind[i] == "u" and "-" not in kind[i + 1 : i + 3]]
        parts.append((over(len(pairs) * capitals * (1 - small**2), secrets.WRITING_CAPITALS, len(pairs) * capitals), over(sum(x != "ll" for x in behind), secrets.WRITING_CAPITALS, len(behind))))
    z = sum(e * x for e, x in parts) / math.sqrt(sum(e * e for e, _ in parts))
    random_looking = n >= 16 and z_chi2 <= 3 and abs(z_runs) <= 3 and abs(z_serial) <= 3 and z > 0
    return name, z_chi2, z_runs, z_serial, math.exp(-z * z / 2) if random_looking else 1.0


def test_battery_equals_a_plain_recomputation(spark):
    r = random.Random(31)
    tokens = ["".join(r.choices(abc, k=r.choice([20, 24, 33, 64, 500]))) + "=" * r.choice([0, 0, 2]) for abc in secrets.ALPHABETS.values() for _ in range(12)]
    tokens += ["MyVeryLongClassNameFactoryBeanImpl2", "a" * 30, "ab" * 20, "2024-01-15-release-candidate-3-build", "0123456789" * 4, "AAAAAAAAAAAAAAAAAAAAAAAA1", "_" * 25 + "a"]
    got = {x["v"]: x for x in secrets._battery(spark.createDataFrame([(t,) for t in tokens], "v string")).collect()}
    for t in tokens:
        name, *want = plain_battery(t)
        assert got[t]["encoding"] == name
        assert [got[t][c] for c in ("z_chi2", "z_runs", "z_serial", "p")] == pytest.approx(want, abs=1e-9), t


def test_discovery_limit_equals_sorted_p_values(spark):
    """Weighted Benjamini-Hochberg; counting in steps moves the limit by one step of -ln p at most."""
    r = random.Random(32)
    rows = [(float(r.choice([20, 40, 100])), min(1.0, math.exp(-abs(r.gauss(0, 3)) ** 2 / 2) if r.random() < 0.3 else r.random() + 1e-9)) for _ in range(2000)]
    limit, mean = secrets.discovery_limit(spark.createDataFrame(rows, "n double, p double"), 0.05)
    assert mean == pytest.approx(sum(n for n, _ in rows) / len(rows))
    q = sorted(p * mean / n for n, p in rows)
    best = max((x for k, x in enumerate(q, 1) if x <= 0.05 * k / len(q)), default=0.0)
    assert best * math.exp(-2 * secrets._STEP) <= limit <= 0.05 and limit <= best * math.exp(2 * secrets._STEP)


def test_random_tokens_are_found_and_names_are_not(spark):
    r = random.Random(5)
    words = "my very long class name factory bean impl abstract service user account manager request handler response list index create update string builder config module".split()
    tokens = [(name, "".join(r.choices(abc, k=n))) for name, abc in secrets.ALPHABETS.items() if name != "mixed" for n in (20, 24, 28) for _ in range(30)]
    for k in range(300):
        w = r.choices(words, k=r.randint(5, 8))
        tokens.append(("name", ("".join(x.capitalize() for x in w) + str(k % 10), "_".join(w), "-".join(w), "/".join(w))[k % 4]))
    found = {x["doc_id"] for x in secrets.scan_secrets(docs(spark, *[f"{prose(i, 20)} {t} end" for i, (_, t) in enumerate(tokens)])).where(F.size("spans") > 0).collect()}
    share = {k: [i in found for i, (name, _) in enumerate(tokens) if name == k] for k in {name for name, _ in tokens}}
    assert sum(share["name"]) <= 3
    assert all(sum(v) >= (0.6 if k == "base32" else 0.85) * len(v) for k, v in share.items() if k != "name"), {k: sum(v) / len(v) for k, v in share.items()}
