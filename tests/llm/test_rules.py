"""Quality rules against plain counting, and the order of the cascade."""

import collections
import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docket_spark.llm import rules
from tests.llm.tables import CLASHING, PROSE, documents, hard_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = PROSE + " " + " ".join(f"further{k} words" for k in range(20)) + "."
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    triples = list(zip(words, words[1:], words[2:]))
    many = collections.Counter(triples)
    again = {k + j for k, t in enumerate(triples) if many[t] > 1 for j in range(3)}
    measures = (
        len(words),
        sum(map(len, words)),
        len(re.findall("[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(again),
    )
    n, m = len(words), max(1, len(lines))
    failed = n < 50 or 2 * len(again) > n
    shouted = [w for w in words if re.search("[A-Z].*[A-Z]", w) and not re.search("[a-z]", w)]
    good = (
        not failed
        and measures[2] <= 0.1 * n
        and 3 <= measures[1] / n <= 10
        and sum(1 for w in words if re.search("[A-Za-z]|[^\x00-\x7f]", w)) >= 0.8 * n
        and len(shouted) <= 0.5 * n
        and sum(1 for x in lines if re.match(r"[\x20\x09-\x0D]*[-*•]", x)) <= 0.9 * m
        and sum(1 for x in lines if x.rstrip(" \t\n\v\f\r").endswith(("...", "…"))) <= 0.3 * m
        and measures[3] <= 0.3 * m
    )
    return measures, failed, good


PIECES = st.sampled_from(["a", "b", "the", "WÖRD", "YES", "#", "| ", " ", "\n", "- x\n", "so...\n", "…\n", "•", "語", "\x0b"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=200).map("".join), st.integers(1, 30))
def test_measures_and_verdict_equal_plain_counting(text, times):
    text = text + (" and some more words" * times)
    seen = rules.Text(text.encode())
    measures, failed, good = plain(text)
    assert tuple(getattr(seen, name) for name in MEASURES) == measures
    assert (rules.first_broken(seen, rules.BASE) is not None) == failed
    assert (rules.first_broken(seen, rules.RULES) is None) == good


def broken_ones():
    """A text per rule that breaks it."""
    words = [f"word{k} " for k in range(60)]
    return {
        "few_words": "too short",
        "repeated_words": "over and over again " * 30,
        "symbols": "".join(w + "# " * (k % 3 == 0) for k, w in enumerate(words)),
        "word_length": " ".join(f"{'long' * 5}{k}" for k in range(60)),
        "alphabetic": "".join(words) + " ".join(str(1000 + k) for k in range(30)),
        "capitals": " ".join(f"LOUD{k}" for k in range(60)),
        "bullets": "\n".join("- " + w for w in words),
        "ellipses": "\n".join(w + " more..." for w in words),
        "repeated_lines": "".join(words) + "\n" + "\n".join(["one line", "another line"] * 3),
    }


def test_each_rule_is_broken_by_its_text():
    texts = broken_ones()
    assert set(texts) == {rule.name for rule in rules.RULES}
    for rule in rules.RULES:
        assert rule.broken(rules.Text(texts[rule.name].encode())), rule.name
        assert not rule.broken(rules.Text((GOOD).encode()))


def test_order_does_not_change_the_verdict():
    texts = [*broken_ones().values(), GOOD, ""]
    draw = random.Random(7)
    want = [rules.first_broken(rules.Text(t.encode()), rules.RULES) is None for t in texts]
    for _ in range(50):
        order = draw.sample(rules.RULES, len(rules.RULES))
        assert [rules.first_broken(rules.Text(t.encode()), order) is None for t in texts] == want


def test_rejections_per_cost_decide_the_order():
    always = lambda x: True
    three = [rules.Rule(name, always, ()) for name in ("dear", "rare", "cheap")]
    # bits: dear 1, rare 2, cheap 4; two needs, then the three rules' nanoseconds
    figures = [(0, 50, [0, 0, 5000, 100, 100]), (5, 40, [0, 0, 4000, 80, 80]), (2, 10, [0, 0, 1000, 20, 20])]
    assert [r.name for r in rules.ordered(three, figures)] == ["cheap", "rare", "dear"]
    # Words are paid by the first rule that needs them; then the second such rule is the cheaper one.
    needy = [rules.Rule("w1", always, ("words",)), rules.Rule("w2", always, ("words",)), rules.Rule("free", always, ())]
    figures = [(1, 60, [90_000, 0, 100, 100, 6000]), (2, 30, [45_000, 0, 50, 50, 3000]), (4, 10, [15_000, 0, 20, 20, 1000])]
    best = rules.ordered(needy, figures)
    assert [r.name for r in best if r.name != "free"] == ["w1", "w2"]
    assert rules.ordered(three, []) == three


def test_first_broken_stops_at_the_first():
    tried = []
    watch = [rules.Rule(str(k), lambda x, k=k: tried.append(k) or k == 2, ()) for k in range(5)]
    assert rules.first_broken(rules.Text(b""), watch) == "2" and tried == [0, 1, 2]


def test_judge_and_keep_good(spark):
    rows = [*hard_rows(), *enumerate([*broken_ones().values(), GOOD], 100)]
    docs = documents(spark, rows)
    order = rules.learn_order(docs, one_in=1)
    assert {x.name for x in order} == {x.name for x in rules.RULES}
    found = rules.judge(docs, order, measures=MEASURES, base=rules.BASE).collect()
    want = collections.Counter()
    for i, text, *_ in rows:
        measures, failed, good = plain(text)
        want[(i, *measures, failed, good)] += 1
    assert collections.Counter(tuple(r) for r in found) == want
    kept = rules.keep_good(docs, order)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t, *_ in rows if plain(t)[2])
    assert kept.first()[CLASHING[0]] == CLASHING[0]


def test_empty_tables_and_empty_samples(spark):
    none = documents(spark, [])
    assert rules.learn_order(none) == list(rules.RULES)
    assert rules.judge(none, rules.RULES).count() == rules.keep_good(none, rules.RULES).count() == 0
    with pytest.raises(ValueError):
        rules.sample_figures(none, list(itertools.islice(itertools.cycle(rules.RULES), 17)))
