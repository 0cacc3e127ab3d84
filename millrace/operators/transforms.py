"""Row transforms: projections, templates, ids, positions. Built-in expressions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import bounded_broadcast, cut


def positioned(df: DataFrame, order: Iterable[str], out: str, start: int = 0, keys: Iterable[str] = (), total: str | None = None) -> DataFrame:
    """0-based place of each row in a total order, overall or within ``keys``, without one task for all rows of a key.

    Rows are range-partitioned by keys and order; each partition numbers its own rows and is shifted by the
    sizes of those before it (one row a key and partition). ``total`` names a column for the rows of the key.
    """
    keys, order = list(keys), list(order)
    ranged = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    every = Window.partitionBy(*keys)
    before = (F.sum("_n").over(every.orderBy("_part")) - F.col("_n")).alias("_before")
    # other names on this side, as both come from one table
    named = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), before, F.sum("_n").over(every).alias("_total"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    number = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    placed = ranged.join(bounded_broadcast(named) if keys else F.broadcast(named), same).withColumn(out, (F.col("_before") + number - 1 + start).cast("long"))
    if total:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.select(*df.columns, out, *([total] if total else []))


def expand_groups(prompts: DataFrame, n: int, group: str) -> DataFrame:
    """n rows per prompt with running index g * n + j."""
    return prompts.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("idx", F.col(group) * n + F.col("j"))


def default_ids(df: DataFrame, column: str, order: str) -> DataFrame:
    """Null ids get the smallest unused whole numbers in the order of the rows."""
    missing = positioned(df.where(F.col(column).isNull()), [order], "_k")
    used = df.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("_i")).distinct()
    count = df.count()
    free = df.sparkSession.range(count + 1).withColumnRenamed("id", "_i").join(used, "_i", "left_anti")
    free = positioned(free, ["_i"], "_k")
    filled = missing.drop(column).join(free, "_k").withColumnRenamed("_i", column).drop("_k")
    return df.where(F.col(column).isNotNull()).unionByName(filled.select(*df.columns))


def resolved_source(source: Column, metadata: Column) -> Column:
    """source, else the metadata's source_name, else unknown."""
    return F.coalesce(F.nullif(source, F.lit("")), F.get_json_object(metadata, "$.source_name"), F.lit("unknown"))


def status_of(finish_reason: Column, current: Column) -> Column:
    return F.when(finish_reason == "length", "truncated").when(finish_reason == "abort", "aborted").when(finish_reason == "stop", "completed").otherwise(current)


def as_messages(prompt: Column) -> Column:
    """A text prompt as one user message."""
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def render_chat(messages: Column, opening: str = "<|{}|>\n", closing: str = "<|end|>\n", reply: bool = True) -> Column:
    """Messages joined by a template; ``reply`` opens the assistant's turn."""
    before, after = opening.split("{}")
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit(before), m["role"], F.lit(after), m["content"], F.lit(closing))), "")
    return F.concat(body, F.lit(before + "assistant" + after)) if reply else body


def word_count(text: Column) -> Column:
    """Words by white space; 0 for null and blank."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``$name`` or ``${name}`` places of a template filled with columns; unknown names are an error."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\$\$|\$(?:\{(\w+)\}|(\w+))", template):
        parts.append(F.lit(template[at : m.start()]))
        if m[0] == "$$":
            parts.append(F.lit("$"))
        else:
            name = m[1] or m[2]
            if name not in values:
                raise KeyError(name)
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        at = m.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def truncated_words(text: Column, n: int) -> Column:
    """The first n white-space tokens, joined by blanks."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, n), " ")


def flatten_parts(parts: Column, separator: str = " ", drop_empty: bool = False, image: str | None = None) -> Column:
    """Text of typed content parts (array of struct<type, text>); images become ``image`` where that is given."""
    texts = F.transform(parts, lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).when((p["type"] == "image") & F.lit(image is not None), F.lit(image)))
    texts = F.array_compact(texts)
    return F.array_join(F.filter(texts, lambda t: t != "") if drop_empty else texts, separator)


def compact_text(text: Column, most: int = 256) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def passages(docs: Column) -> Column:
    """``Doc i(Title: t) text`` lines of an array of struct<title, text>."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), d["title"], F.lit(") "), d["text"])), "\n")


def log10p(x: Column) -> Column:
    return F.log1p(x) / F.log(F.lit(10.0))


def inverse_log10p(y: Column) -> Column:
    return F.expm1(y * F.log(F.lit(10.0)))


def expand_dates(text: Column, due: Column, resolution: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{forecast_due_date}"), due.cast("string")), F.lit("{resolution_date}"), resolution.cast("string"))


def default_mask(mask: Column, length: Column, removed: Column) -> Column:
    """The mask, ones where there is none, zeros for removed samples; its length must be the response's."""
    filled = F.coalesce(mask, F.array_repeat(F.lit(1), length))
    return F.when(removed, F.array_repeat(F.lit(0), length)).otherwise(filled)


def sft_lengths(mask: Column) -> Column:
    """Response length of a supervised sample: from the first trained token to the end; 0 if none is trained."""
    first = F.array_position(mask, 1)
    return F.when(first > 0, F.size(mask) - first + 1).otherwise(0)


def role_checked(messages: Column, roles: Iterable[str] = ("system", "user", "assistant", "tool")) -> Column:
    """Messages whose roles are all known, null otherwise."""
    roles = list(roles)
    return F.when(F.forall(messages, lambda m: m["role"].isin(*roles)), messages)
