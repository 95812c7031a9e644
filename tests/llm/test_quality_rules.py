from collections import Counter

from lacewing.llm import quality_rules as q

WS = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    w = text.encode().split()
    lines = [s for s in text.split("\n") if s.strip(WS)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    hit = {k for i, x in enumerate(windows) if n[x] > 1 for k in range(i, i + 5)}
    chars = sum(c not in WS for c in text)
    return len(w), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_measurements(messy, messy_rows, rows_of, in_order):
    want = in_order([(i, *brute(t)) for i, t in messy_rows])
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert rows_of(q.measure(messy), *columns) == want


def test_base_policy_and_ledger(messy, messy_rows, rows_of, in_order):
    base = lambda m: m[0] < 10 or 100 * m[4] > 20 * m[0]
    want = in_order([(i, not base(brute(t))) for i, t in messy_rows])
    rows = q.ledger(messy)
    assert rows_of(q.apply_policy(rows, "base"), "doc_id", "kept") == want
    assert q.apply_policy(rows, "v2").where("kept").count() <= sum(k for _, k in want)


def test_ablations(messy):
    rows = q.ledger(messy)
    failures = [r.failures & q.mask("v2") for r in rows.select("failures").collect()]
    for r in q.ablations(rows, "v2").collect():
        b = q.bit(r.rule)
        assert r.n_failed == sum(f & b != 0 for f in failures)
        assert r.n_failed_alone == sum(f == b for f in failures)
        assert r.n_kept_without == sum(f & ~b == 0 for f in failures)


def test_no_python_in_the_plan(messy):
    plan = q.ledger(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("Exchange RoundRobin", "")


def test_empty_table(nothing):
    assert q.ledger(nothing).count() == 0
