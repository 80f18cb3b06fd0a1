import hashlib
import random
import re
from collections import defaultdict

from gatecast.llm import mixing

from .conftest import words

PLAN = mixing.Plan(numerator=4, denominator=5, max_epochs=2, seed=3, domains=[("^a", "first"), ("b", "second")],
                   domain_weights={"first": 1, "second": 5}, lang_weights={"en": 3})
SCHEMA = "doc_id long, lang string, source string, text string, mix int, domain string"


def fill(children, budget):
    """(name, supply, weight) -> given, by handing out to the unfilled until nothing changes."""
    given, open_ = {}, sorted(children, key=lambda c: (c[1] / c[2], c[0]))
    left, weight = budget, sum(c[2] for c in children)
    while open_:
        name, supply, w = open_[0]
        if supply * weight > w * left:
            break
        given[name] = supply
        left, weight = left - supply, weight - w
        open_.pop(0)
    return given | {name: w * left // weight for name, _, w in open_}


def brute(rows, plan):
    def leaf(r):
        s = r[2] if r[2] is not None else "none"
        domain = next((name for pattern, name in plan.domains if re.search(pattern, s)), "other")
        return (domain, "none" if r[1] is None else r[1], s)

    tokens = defaultdict(int)
    for r in rows:
        tokens[leaf(r)] += len(words(r[3]))
    supply = lambda k: sum(t for x, t in tokens.items() if x[:len(k)] == k) * plan.max_epochs
    kids = lambda k: sorted({x[:len(k) + 1] for x in tokens if x[:len(k)] == k})
    weights = lambda k: (plan.domain_weights, plan.lang_weights, {})[len(k) - 1].get(k[-1], 1)
    budget = {(): sum(tokens.values()) * plan.numerator // plan.denominator}
    for depth in range(3):
        for k in [k for k in budget if len(k) == depth]:
            budget |= fill([(c, supply(c), weights(c)) for c in kids(k)], budget[k]) if kids(k) else {}
    out = []
    for k, t in tokens.items():
        mine = [r for r in rows if leaf(r) == k]
        epochs, rest = divmod(budget[k], t) if t else (0, 0)
        key = lambda r: hashlib.md5(f"{plan.seed}:{epochs}:{'none' if r[0] is None else r[0]}".encode()).hexdigest()
        for r in mine:
            run = sum(len(words(o[3])) for o in mine if key(o) <= key(r))
            out.append((r[0], *k, len(words(r[3])), t, budget[k], epochs + (1 if t and run <= rest else 0)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    rows = [(i, rng.choice(("en", "de", None)), rng.choice(("a1", "a2", "b1", "c", None)), "wort " * rng.randint(0, 40), 1, "x") for i in range(400)]
    rows += [(1000 + i, "en", "hot", "wort wort", 1, "x") for i in range(800)]
    rows += [(None, "en", "a1", "two words", 1, "x"), (None, "en", "a1", "two words", 1, "x"), (5, "en", "b1", None, 1, "x"), (6, "zz", "empty", "", 1, "x"),
             (3, "en", "a1", "three words here", 1, "x"), (3, "en", "a1", "three words here", 1, "x")]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, PLAN, "out")
    assert got.columns == [*docs.columns, "out"]
    flat = sorted((tuple(r) for r in got.select("doc_id", "out.*").collect()), key=str)
    assert flat == brute(rows, PLAN)
    assert len({r[-1] for r in flat}) > 1
    taken = mixing.take_mixed(docs, PLAN)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r[-1] for r in flat)


def test_empty_table(spark):
    assert mixing.take_mixed(spark.createDataFrame([], SCHEMA), PLAN).collect() == []
