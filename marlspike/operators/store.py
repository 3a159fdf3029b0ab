"""Keyed tables without transactions: upsert, update, delete as rewrites of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """The last version of each key: aggregated before the shuffle, so a hot key costs one row a task.

    Versions that tie are told apart by a hash of the row, so the result doesn't depend on the order.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    picked = df.groupBy(*keys).agg(F.max_by(row, F.struct(*version, F.xxhash64(*[F.to_json(F.struct(c)) for c in rest]))).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; the others stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def update(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Columns set where the condition holds; null is not true."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key isn't in ``keys``."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(~F.coalesce(condition, F.lit(False)))


def delete_stale(df: DataFrame, current: DataFrame, key: str, same: str) -> DataFrame:
    """Rows that share ``same`` with a current row but have another ``key`` go."""
    now = current.select(F.col(same), F.col(key).alias("__now")).filter(F.col(same).isNotNull())
    shared = now.select(same).distinct().withColumn("__shared", F.lit(True))
    mine = now.select(same, F.col("__now").alias(key)).distinct().withColumn("__mine", F.lit(True))
    kept = df.join(shared, same, "left").join(mine, [same, key], "left").filter("__shared is null or __mine")
    return kept.select(*df.columns)


def insert(df: DataFrame, key: str, constants: dict[str, Column]) -> DataFrame:
    """New rows with generated ids and constants."""
    return df.withColumns({key: F.expr("uuid()"), **constants})


def lookup(df: DataFrame, keys: dict[str, object]) -> DataFrame:
    """The row of a key, pushed down to the scan."""
    cond = F.lit(True)
    for c, v in keys.items():
        cond = cond & (F.col(c) == F.lit(v))
    return df.filter(cond).limit(1)


def by_first_or_second(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], payload: str) -> DataFrame:
    """``payload`` of ``right`` joined by the first pair of columns, else by the second; each key at most once."""

    def side(pair: tuple[str, str], name: str) -> DataFrame:
        one = right.filter(F.col(pair[1]).isNotNull()).groupBy(pair[1]).agg(F.min(payload).alias(name))
        return one.withColumnRenamed(pair[1], f"__{name}")

    a, b = side(first, "p1"), side(second, "p2")
    out = left.join(a, F.col(first[0]) == F.col("__p1"), "left").join(b, F.col(second[0]) == F.col("__p2"), "left")
    return out.withColumn(payload, F.coalesce("p1", "p2")).drop("p1", "p2", "__p1", "__p2")


def moment(c: Column) -> Column:
    """ISO text as a timestamp; blank and malformed ones are null."""
    return F.try_to_timestamp(F.nullif(F.trim(c), F.lit("")))


def attributes(users: DataFrame) -> DataFrame:
    """Name-value attributes as columns: email, role (default user), sub, username (default the address's local part)."""

    def value(name: str) -> Column:
        found = F.filter("attributes", lambda a: a["name"] == name)
        return F.try_element_at(found, F.lit(-1))["value"]

    email = F.coalesce(value("email"), F.lit(""))
    return users.select(
        F.col("username").alias("id"), F.col("userstatus").alias("status"), F.col("usercreatedate").alias("joined"), value("sub").alias("sub"), email.alias("email"),
        F.coalesce(value("custom:role"), F.lit("user")).alias("role"), F.coalesce(F.nullif(value("name"), F.lit("")), F.split(email, "@")[0]).alias("username"),
        value("custom:data_consent").alias("consent"),
    )


def activity(files: DataFrame, chats: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """The last n events of uploads, chats and registrations; each source gives its own n first."""

    def top(df: DataFrame) -> DataFrame:
        return df.orderBy(F.col("ts").desc_nulls_last(), "icon", "description").limit(n)

    say = lambda what, name: F.concat(F.lit(what), name)
    a = files.select(F.lit("upload").alias("icon"), moment(F.col("uploaded_at")).alias("ts"), say("New document uploaded: ", F.coalesce("filename", F.lit("N/A"))).alias("description"))
    b = chats.select(F.lit("chat").alias("icon"), moment(F.col("created_at")).alias("ts"), say("New conversation started: ", F.coalesce("title", F.lit("Untitled"))).alias("description"))
    c = attributes(users).select(F.lit("user").alias("icon"), F.col("joined").alias("ts"), say("New user registered: ", F.col("username")).alias("description"))
    return top(top(a.distinct()).unionByName(top(b.distinct())).unionByName(top(c.distinct())))


def delete_everywhere(tables: dict[str, tuple[DataFrame, str]], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table (and the name of its column) without the keys: index, metadata and stored objects go together."""
    return {name: delete_keys(df, keys.select(F.col(key).alias(column)), [column]) for name, (df, column) in tables.items()}


def set_attribute(users: DataFrame, condition: Column, name: str, value: Column) -> DataFrame:
    """Users with one attribute set where the condition holds: replaced where it is, else put at the end."""
    had = F.coalesce(F.col("attributes"), F.array().cast("array<struct<name:string,value:string>>"))
    new = F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    changed = F.when(F.exists(had, lambda a: a["name"] == name), F.transform(had, lambda a: F.when(a["name"] == name, new).otherwise(a))).otherwise(F.concat(had, F.array(new)))
    return users.withColumn("attributes", F.when(F.coalesce(condition, F.lit(False)), changed).otherwise(F.col("attributes")))


def rewrite_key(records: DataFrame, identities: DataFrame, on: str, key: str, new: str) -> DataFrame:
    """Records with ``key`` replaced by the identity's ``new`` for the same ``on``; records without an identity are left out."""
    known = identities.filter(F.col(on).isNotNull()).groupBy(on).agg(F.min(new).alias("__new"))
    return records.join(known, on).withColumn(key, F.col("__new")).drop("__new")


def allowed(value: Column, states: tuple[str, ...]) -> Column:
    """Whether a value is one of the allowed states; null isn't."""
    return F.coalesce(value.isin(*states), F.lit(False))


def file_list(files: DataFrame) -> DataFrame:
    """Files as a client lists them: name, size (0 if unknown); rows without a name are left out."""
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long") if "size" in files.columns else F.lit(0).cast("long")
    return files.filter("filename is not null").select(F.col("filename").alias("name"), size.alias("size"))


def with_status(df: DataFrame, status: str | None, column: str = "status") -> DataFrame:
    """Rows of a state; all of them for None and "all"."""
    return df if status in (None, "all") else df.filter(F.col(column) == status)
