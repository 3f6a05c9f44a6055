"""Intake conflicts (O48): order, chains, null and repeated rows."""

import random

import pytest

from tickwise.operators import identity as ID

SCHEMA = "candidate_id long, username string, email string, tier string"


def _sequential(rows, names=(), emails=()):
    names, emails, out = set(names), set(emails), []
    for i, u, e, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ok = u not in names and e not in emails
        if ok:
            names.add(u)
            emails.add(e)
        out.append((i, u, e, "ok" if ok else "conflict"))
    return sorted(out, key=str)


def _checked(spark, rows, users=()):
    u = spark.createDataFrame(list(users), "username string, email string")
    got = ID.intake_check(spark.createDataFrame(rows, SCHEMA).repartition(5), u).collect()
    return sorted(((r["candidate_id"], r["username"], r["email"], r["status"]) for r in got), key=str)


@pytest.mark.parametrize("seed,n,names", [(1, 300, 40), (2, 300, 120), (3, 200, 12)])
def test_any_conflicts_as_one_after_the_other(spark, seed, n, names):
    draw = random.Random(seed)
    rows = [(i, f"name{draw.randrange(names)}", f"m{draw.randrange(names)}@x.yz", None) for i in range(n)]
    draw.shuffle(rows)
    assert _checked(spark, rows, [("name3", "none@x.yz"), ("nobody", "m5@x.yz")]) == _sequential(rows, ["name3"], ["m5@x.yz"])


def test_long_chain_in_few_rounds(spark, monkeypatch):
    """Every candidate shares a name with the one before and an email with the one after."""
    rows = [(i, f"user{(i + 1) // 2}", f"m{i // 2}@x.yz", None) for i in range(10_000)]
    written = []
    kept = ID._kept
    monkeypatch.setattr(ID, "_kept", lambda df: written.append(1) or kept(df))
    assert _checked(spark, rows) == _sequential(rows)
    assert len(written) < 4 + 1 + 20  # the first tables, the links, and a table a round


def test_rising_and_falling_chains(spark):
    order = [5, 3, 9, 1, 7, 2, 8, 0, 6, 4]
    rows = [(10 * k + order[i % 10], f"user{k}_{(i + 1) // 2}", f"m{k}_{i // 2}@x.yz", None) for k in range(30) for i in range(10)]
    assert _checked(spark, rows) == _sequential(rows)


def test_one_hot_name_with_chains_below(spark):
    rows = [(i, "hotname", f"m{i // 3}@x.yz", None) if i % 2 else (i, f"user{i // 4}", f"m{i // 3}@x.yz", None) for i in range(1, 600)]
    assert _checked(spark, rows) == _sequential(rows)


def test_no_row_is_lost_or_doubled(spark):
    rows = [(None, "abcd", "a@x.yz", None), (None, "bcde", "b@x.yz", None), (1, "abcd", "z@x.yz", None), (2, "cdef", "c@x.yz", "pro"), (2, "cdef", "c@x.yz", "pro"),
            (3, "cdef", "q@x.yz", None), (None, None, None, None), (None, "bcde", "b@x.yz", None)]
    got = _checked(spark, rows)
    assert got == sorted([(1, "abcd", "z@x.yz", "ok"), (None, "abcd", "a@x.yz", "conflict"), (None, "bcde", "b@x.yz", "ok"), (None, "bcde", "b@x.yz", "conflict"),
                          (2, "cdef", "c@x.yz", "ok"), (2, "cdef", "c@x.yz", "conflict"), (3, "cdef", "q@x.yz", "conflict"), (None, None, None, "invalid_username")], key=str)
    assert _checked(spark, []) == []
