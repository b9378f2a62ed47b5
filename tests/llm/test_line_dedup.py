import random

import numpy as np
import pyarrow as pa
import pytest

from pagequill.llm import line_dedup


def brute(rows, t=0.8):
    gone, seen = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        out = []
        for k, line in enumerate((text or "").encode().lower().split(b"\n")):
            w = frozenset(line.split())
            if w and any(len(w & v) >= t * len(w | v) - 1e-9 for v in seen):
                out.append(k)
            seen += [w] if w else []
        gone[i] = out
    return gone


def near_groups(seed):
    """Groups around the threshold, so that many sets try partners in vain."""
    r, rows = random.Random(seed), []
    bases = [[f"b{g}w{k}" for k in range(n)] for g, n in enumerate((6, 11, 30, 31, 90, 400))]
    for i in range(60):
        lines = []
        for _ in range(5):
            w = list(r.choice(bases))
            for _ in range(r.choice([0, 1, len(w) // 9, len(w) // 8, len(w) // 7])):
                w[r.randrange(len(w))] = f"x{r.randrange(300)}"
            r.shuffle(w)
            lines.append(r.choice([" ", "\t", "\x0b ", "  "]).join(w).replace("b0", "B0"))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(("most", "hot", "per_list", "tries"), [(1 << 20, 20_000, 4, 3), (1 << 20, 3, 1, 1), (40, 2, 2, 1), (0, 20_000, 1, 1)])
def test_equals_brute_force(spark, monkeypatch, most, hot, per_list, tries):
    for name, value in (("HOT_LIST", hot), ("PER_LIST", per_list), ("TRIES", tries)):
        monkeypatch.setattr(line_dedup, name, value)
    rows = near_groups(5)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), report=True, most=most).collect()
    assert {r["doc_id"]: list(r["removed_lines"]) for r in got} == brute(rows)


def test_odd_rows(spark):
    long_word = "q" * 700
    rows = [
        (7, "a b c d e\n" + long_word), (2, "a b c d e"), (2, "a b c d e"), (3, None), (4, ""), (5, "\n \x0c\n"), (None, "a b c d e\nunique line here"),
        (8, f"{long_word}\n{long_word}z"), (9, "A\x0bB c\x1cx"), (10, "é ü ß\nÉ ü ß"), (11, " ".join(f"k{i}" for i in range(30_000)) + "\n" + " ".join(f"k{i}" for i in range(100, 30_000))),
    ]
    names = "doc_id long, text string, row string, gone string, id string, tk string, line string, removed string, mark string, __at string, `a.b` string"
    df = spark.createDataFrame([(*r, *"abcdefghi") for r in rows], names)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted(out.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] or ""))
    texts = [(r["doc_id"], r["text"]) for r in got]
    # Equal lines at equal places of one id don't remove each other.
    assert texts[:2] == [(2, "a b c d e")] * 2
    assert texts[2:5] == [(3, None), (4, ""), (5, "\n \x0c\n")]
    assert texts[5] == (7, long_word) and texts[6] == (8, f"{long_word}z")
    assert texts[8] == (10, "é ü ß\nÉ ü ß") and texts[9][1].count("\n") == 0 and texts[10] == (None, "unique line here")
    assert all(r["a.b"] == "i" and r["row"] == "a" for r in got)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "one two three"), ("a", "Three two one"), (None, "one two three")], "doc_id string, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()} == {"a": "Three two one", "b": "", None: ""}


def test_word_hashes_tell_words_apart():
    r = random.Random(3)
    words = list({"".join(r.choice("ab") for _ in range(r.choice([1, 7, 8, 9, 15, 16, 17, 24, 255, 256, 257, 300]))) for _ in range(4000)})
    h = line_dedup._hashes(pa.array(words))
    assert len(np.unique(h)) == len(words)
    assert (line_dedup._hashes(pa.array(["pad", *words]).slice(1)) == h).all()
    order = line_dedup.Order(h[:500].copy(), np.arange(500))
    n = order.numbers(h)
    assert sorted(n[:500]) == list(range(500)) and (n[500:] < 0).all()


def test_lines_go_without_python_and_texts_unsorted(spark):
    rows = [(i, f"same old line here\n\nown{i} words of{i} it{i}\nsame old line here\n") for i in range(50)] + [(50, ""), (51, None)]
    df = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SortMergeJoin" not in plan
    assert {r["doc_id"]: r["text"] for r in df.collect()} == {i: None if t is None else t if i in (0, 50) else t.replace("same old line here\n", "") for i, t in [(0, rows[0][1].replace("same old line here\n", "", 2).join(["same old line here\n", ""])), *rows[1:]]}


@pytest.mark.parametrize("high", [3, 1 << 22])
def test_order_of_postings(high):
    r = np.random.default_rng(1)
    key, cid = r.integers(-40, 40, 3000), r.integers(0, high, 3000) << 40 | r.permutation(3000)
    assert (line_dedup._by_key(key, cid) == np.lexsort((cid, key))).all()
    assert len(line_dedup._by_key(key[:0], cid[:0])) == 0
