"""Identity tables in batch.

Per-request lookups of the service become equi-joins on unique keys. A hot
API key (one client sending a third of all requests) only makes one side of
a shuffled join skewed; the other side has one row per key, which is the
case AQE's skew-join split handles (the hot partition is split, the single
key row is replicated).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# Key format (prefix, minimum length exclusive) and the user
# field rules of the registration model. The prefix is a deployment setting;
# the fixture keys use "key_".
KEY_PREFIX = "key_"
KEY_MIN_LENGTH_EXCLUSIVE = 10
USERNAME_MIN, USERNAME_MAX = 3, 50
EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+$"
HINT_LENGTH = 10


def key_format_ok(key, prefix: str = KEY_PREFIX):
    k = F.col(key) if isinstance(key, str) else key
    return k.startswith(prefix) & (F.length(k) > KEY_MIN_LENGTH_EXCLUSIVE)


def resolve_keys(presented: DataFrame, api_keys: DataFrame, users: DataFrame,
                 prefix: str = KEY_PREFIX, key_col: str = "api_key") -> DataFrame:
    """Presented key -> user, or the reason it fails. ``expires_at`` is
    carried but, as in the service, not checked."""
    fmt = key_format_ok(F.col(key_col), prefix)
    active = (api_keys.where(F.col("is_active"))
                      .select(F.col("key").alias(key_col), F.col("user_id").alias("key_user_id")))
    u = users.select(F.col("id").alias("key_user_id"), F.col("is_active").alias("user_active"))
    # Malformed keys never reach the lookup: their join key is NULL.
    probe = presented.withColumn("__lookup", F.when(fmt, F.col(key_col)))
    joined = (probe.join(active.withColumnRenamed(key_col, "__lookup"), "__lookup", "left")
                   .join(u, "key_user_id", "left"))
    reason = (F.when(~fmt, F.lit("invalid_format"))
              .when(F.col("key_user_id").isNull(), F.lit("invalid_key"))
              .when(F.col("user_active").isNull() | ~F.col("user_active"), F.lit("user_inactive"))
              .otherwise(F.lit("ok")))
    return (joined.withColumn("reason", reason)
                  .withColumn("user_id", F.when(F.col("reason") == "ok", F.col("key_user_id")))
                  .withColumn("status_code", F.when(F.col("reason") == "ok", F.lit(200))
                              .otherwise(F.lit(401)))
                  .drop("__lookup", "key_user_id", "user_active"))


def key_listing(api_keys: DataFrame, user_id: int | None = None) -> DataFrame:
    """Keys (of one user) with only their first 10 characters shown."""
    if user_id is not None:
        api_keys = api_keys.where(F.col("user_id") == user_id)
    hint = F.concat(F.substring(F.col("key"), 1, HINT_LENGTH), F.lit("..."))
    return api_keys.select("user_id", "id", hint.alias("key_hint"), "is_active",
                           "created_at", "expires_at")


def deactivate_keys(api_keys: DataFrame, revocations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O47, write side: (keys after, revocations with ``status_code``). A
    revocation (user_id, key id in ``key_id``) counts if that key is the
    user's: 200, also if the key is inactive already; else 404 and nothing
    changes. Repeated ones count alike; null ids find nothing."""
    owned = api_keys.select(F.col("id").alias("key_id"), "user_id").distinct().withColumn("__owned", F.lit(True))
    told = revocations.join(owned, ["key_id", "user_id"], "left")
    told = told.withColumn("status_code", F.when(F.col("__owned"), F.lit(200)).otherwise(F.lit(404))).drop("__owned").select(*revocations.columns, "status_code")
    gone = revocations.select(F.col("key_id").alias("id"), "user_id").distinct().withColumn("__gone", F.lit(True))
    after = api_keys.join(gone, ["id", "user_id"], "left").withColumn("is_active", F.col("is_active") & F.col("__gone").isNull())
    return after.select(*api_keys.columns), told


def intake_check(candidates: DataFrame, users: DataFrame, order: str = "candidate_id") -> DataFrame:
    """Validate registrations and flag conflicts, with existing users and
    with candidates before them: of two valid ones with the same username or
    email the later is refused. They come in the order of ``order``, null last;
    rows that agree in it in any order, but one after the other, so that of
    equal rows one is accepted. Every row comes back once.

    "username OR email exists" is two equi-joins against the distinct
    username and email lists (an OR join condition would force a nested-loop
    join). Candidates that are first by both names are accepted at once and
    those that share a name with them refused, in rounds while these settle
    half of what is open. What is left depends on earlier candidates that may
    be refused themselves: ``_settled``.
    """
    valid_name = F.length("username").between(USERNAME_MIN, USERNAME_MAX)
    valid_email = F.col("email").rlike(EMAIL_PATTERN)
    tier = F.when(F.col("tier").isin("free", "pro", "premium"), F.col("tier")).otherwise(F.lit("free"))
    status = F.when(~F.coalesce(valid_name, F.lit(False)), F.lit("invalid_username")).when(~F.coalesce(valid_email, F.lit(False)), F.lit("invalid_email"))
    c = candidates.withColumns({"tier": tier, "status": status, "__row": F.monotonically_increasing_id()})
    c = _kept(c.withColumn("__place", F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("at"), F.col("__row").alias("row"))))

    first = _kept(_split(c.where(F.col("status").isNull()), users))
    done = [c.where(F.col("status").isNotNull()), first.where(F.col("status").isNotNull())]
    still = first.where(F.col("status").isNull())
    n = still.count()
    while n:
        by_name = still.groupBy("username").agg(F.min("__place").alias("__n"))
        by_email = still.groupBy("email").agg(F.min("__place").alias("__e"))
        leads = (F.col("__place.row") == F.col("__n.row")) & (F.col("__place.row") == F.col("__e.row"))
        ranked = _kept(still.join(by_name, "username").join(by_email, "email").withColumn("__lead", leads).drop("__n", "__e"))
        accepted = ranked.where("__lead").drop("__lead")
        left = _kept(_split(ranked.where(~F.col("__lead")).drop("__lead"), accepted))
        done += [accepted.withColumn("status", F.lit("ok")), left.where(F.col("status").isNotNull())]
        still, before = left.where(F.col("status").isNull()), n
        n = still.count()
        if 2 * n > before:  # long chains: such rounds would take them apart link by link
            ok = _settled(still)
            done.append(still.join(ok, "__row", "left").withColumn("status", F.when(F.col("__ok"), F.lit("ok")).otherwise(F.lit("conflict"))).drop("__ok"))
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("__row", "__place")


def _kept(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "intake")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _split(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Marks rows that conflict with ``taken`` names."""
    names = taken.select("username", F.lit(True).alias("__name")).distinct()
    emails = taken.select("email", F.lit(True).alias("__email")).distinct()
    met = rows.join(names, "username", "left").join(emails, "email", "left")
    return met.withColumn("status", F.when(F.col("__name").isNotNull() | F.col("__email").isNotNull(), F.lit("conflict"))).drop("__name", "__email")


def _settled(rows: DataFrame) -> DataFrame:
    """(__row, __ok) of candidates that depend on each other, by contracting
    chains of conflicts.

    Let n(i) and e(i) say that the name or the email of candidate i is taken
    before it; it is accepted if neither is. For the candidate j that has the
    same name next, n(j) = n(i) or not e(i); likewise e. A value whose one
    side is known is the other side, or its opposite: a pointer. Pointers to
    pointers are shortened in each round, so a chain of any kind of
    alternating refusals ends after the logarithm of its length, not after one
    round for each link. The earliest open value always has known sides, so
    the rounds end. ``a`` is the same side of the candidate before and ``b``
    its other side; a pointer has no ``b``.
    """
    before = {side: F.lag("__row").over(Window.partitionBy(name).orderBy("__place")) for side, name in enumerate(("username", "email"))}
    linked = rows.select("__row", *[prev.alias(f"__p{side}") for side, prev in before.items()])
    values = [linked.select((F.col("__row") * 2 + side).alias("v"), F.when(F.col(f"__p{side}").isNull(), F.lit(False)).alias("val"),
                            (F.col(f"__p{side}") * 2 + side).alias("a"), (F.col(f"__p{side}") * 2 + 1 - side).alias("b"), F.lit(False).alias("neg")) for side in (0, 1)]
    now = _kept(values[0].unionByName(values[1]))
    while True:
        a, b = ([F.col("v").alias(k), *[F.col(c).alias(f"__{k}_{c}") for c in ("val", "a", "b", "neg")]] for k in ("a", "b"))
        met = now.where(F.col("val").isNull()).join(now.select(*a), "a", "left").join(now.select(*b), "b", "left")
        va, vb, neg = F.col("__a_val"), F.col("__b_val"), F.col("neg")
        # What an open side points to, and whether as its opposite; it may be no pointer itself.
        at = {k: (F.when(F.col(f"__{k}_b").isNull(), F.col(f"__{k}_a")).otherwise(F.col(k)), F.when(F.col(f"__{k}_b").isNull(), F.col(f"__{k}_neg")).otherwise(F.lit(False))) for k in ("a", "b")}
        (to_a, neg_a), (to_b, neg_b) = at["a"], at["b"]
        one = F.col("b").isNull()
        same = va.isNull() & vb.isNull() & (to_a == to_b)
        val = (F.when(one, F.when(va.isNotNull(), va != neg))
               .when(va | ~vb, F.lit(True)).when(~va & vb, F.lit(False)).when(same & (neg_a == neg_b), F.lit(True)))
        to = F.struct(F.when(one, to_a).when(~va, to_b).when(vb | same, to_a).otherwise(F.col("a")).alias("a"),
                      F.when(one | ~va | vb | same, F.lit(None).cast("long")).otherwise(F.col("b")).alias("b"),
                      F.when(one, neg != neg_a).when(~va, ~neg_b).when(vb | same, neg_a).otherwise(F.lit(False)).alias("neg"))
        step = met.select("v", val.alias("val"), to.alias("to")).select("v", "val", "to.a", "to.b", "to.neg")
        now = _kept(now.where(F.col("val").isNotNull()).unionByName(step))
        if now.where(F.col("val").isNull()).isEmpty():
            break
    return now.groupBy(F.floor(F.col("v") / 2).alias("__row")).agg((~F.bool_or("val")).alias("__ok"))
