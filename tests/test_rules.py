import json
import random

from ledgerloom.operators import rules
from ledgerloom.plans import checks

SUM = [{"lhs": "a + b", "operator": "=", "rhs": "c", "tol": 0.0}]
ROW = "row_id int, a bigint, b bigint, c bigint"


def needs(row, most):
    """The fewest edits of a sum by all values within `most` edits of each part and total."""
    from itertools import product

    def near(n):
        layers, seen = [{str(n)}], {str(n)}
        for _ in range(most):
            nxt = set()
            for s in layers[-1]:
                for i in range(len(s) + 1):
                    nxt |= {s[:i] + d + s[i:] for d in "0123456789"} | ({s[:i] + d + s[i + 1 :] for d in "0123456789"} if i < len(s) else set()) | ({s[:i] + s[i + 1 :]} if i < len(s) and len(s) > 1 else set())
            nxt = {s for s in nxt if s == "0" or not s.startswith("0")} - seen
            seen |= nxt
            layers.append(nxt)
        return {int(s): k for k, layer in enumerate(layers) for s in layer}

    a, b, c = map(near, row)
    return min((x + y + c[m + n] for (m, x), (n, y) in product(a.items(), b.items()) if m + n in c), default=None)


def test_registered_search_finds_two_edits(spark, monkeypatch):
    rng = random.Random(5)
    data = []
    while len(data) < 12:
        a, b = rng.randint(10, 999), rng.randint(10, 999)
        slip = lambda n: int(str(n)[:-1] + str((n + rng.randint(1, 9)) % 10))
        row = (slip(a), int("1" + str(b)), a + b)
        if needs(row, 1) == 2:
            data.append((len(data), *row))
    monkeypatch.setattr(checks, "_slips", lambda s, root: s.createDataFrame(data, ROW))
    got = {r.row_id: json.loads(r.edits or "null") for r in checks.fewest_edits(spark, "").collect()}
    assert [len(got[k] or ()) for k in range(len(data))] == [2] * len(data)


def test_states_are_tested_before_the_bound_drops_them(spark):
    d = spark.createDataFrame([(1, 183, 497, 579)], ROW)
    r = rules.fewest_edits(d, SUM, ["row_id"], ["a", "b", "c"], states=200).first()
    assert r.edits and len(json.loads(r.edits)) == 2


def test_rules_that_share_a_variable_may_be_mended_elsewhere(spark):
    d = spark.createDataFrame([(1, 7, 3, 4)], ROW)
    two = [{"lhs": "a", "operator": "=", "rhs": "b + 90", "tol": 0.0}, {"lhs": "c", "operator": "=", "rhs": "b + 40", "tol": 0.0}]
    r = rules.fewest_edits(d, two, ["row_id"], ["a", "b", "c"]).first()
    assert {e["variable"] for e in json.loads(r.edits)} == {"a", "c"}
