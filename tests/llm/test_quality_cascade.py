"""Quality cascade against plain definitions, and its order."""

import re

from sluiceway.llm import quality_cascade as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    "one two three one two three four", "a a a a", "x\nx\n \nx", "# a | b <c>", " ".join(f"w{i}" for i in range(60)),
    " ".join(f"W{i}A" for i in range(60)), " ".join(f"w{i}!!" for i in range(60)), "\n".join(f"- item {i} of many" for i in range(30)),
    "\n".join(f"line {i} of many..." for i in range(30)), "\n".join(f"some line {i % 4} here" for i in range(40)), " ".join(f"w{i}***" for i in range(60)),
    " ".join("y" * 150 + str(i) for i in range(60)), "ß É é " * 20, None, "",
]


def judged(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return Q.judge(docs).orderBy("doc_id").collect()


def test_measures_and_verdicts(spark):
    rows = judged(spark, TEXTS)
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows] == [plain(t) for t in TEXTS]
    assert [r.kept for r in rows] == [i == 4 for i in range(len(TEXTS))]
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)


def test_order_changes_no_verdict(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    other = Q.judge(docs, rules=Q.RULES[::-1], sample_rows=3)
    assert {tuple(r) for r in other.collect()} == {tuple(r) for r in Q.judge(docs).collect()}


def test_greedy_order():
    # b rejects most per second; of what it leaves, a rejects nothing more and c does.
    order = Q.greedy_order(["a", "b", "c"], [10, 10, 40], {0b011: 50, 0b010: 10, 0b100: 20, 0: 20})
    assert [name for name, _, _ in order] == ["b", "c", "a"]
    assert [share for _, _, share in order] == [0.6, 0.5, 0.0]


def test_short_circuit(spark):
    seen = []
    rules = (Q.Rule("first", lambda m: True), Q.Rule("second", lambda m: seen.append(1) or False))
    Q._judge(rules)(__import__("pyarrow").array([TEXTS[4].encode()]))
    assert not seen


def test_odd_input(odd_docs, no_docs):
    rows = Q.judge(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(r.kept for r in rows) and rows[0].copies == "old"
    assert Q.judge(no_docs).count() == 0
    assert Q.judge(odd_docs).columns == ["doc_id", "text", "lang", "source", "n_tokens", "copies", *Q.BASE, "base_failed", "kept"]
