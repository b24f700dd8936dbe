"""Schemas that drift between the files of a feed: one table of all records, and a log of every change.

The headers of all files are read in parallel, the kinds of every field fold in a lattice of promotions to one union
schema, and the files' records are cast to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.exec import cut, sized
from cairnframe.functions.jsontext import exploded, get, kind_of, text_of, with_object
from cairnframe.functions.sequence import with_previous

# Patterns that give a field its meaning, looked for in its letters and digits in lower case, in this order.
MEANINGS = (
    ("bucket", "^bucket(name)?$"),
    ("object_key", "^(object)?key$"),
    ("version_id", "^version(id)?$"),
    ("task_status", "taskstat(us|e)"),
    ("http_status_code", "http|^status(code)?$"),
    ("error_code", "err|fehler|fail|fault"),
    ("result_message", "result|message|msg|text|ergebnis|meldung|nachricht"),
    ("http_status_code", "status"),
)
#: Fields of a report row that a record can carry.
FIELDS = ("bucket", "object_key", "version_id", "task_status", "error_code", "http_status_code", "result_message")
#: Kinds in the order of their bits.
KINDS = ("array", "boolean", "decimal number", "integer", "object", "string")
#: Share of a field's values that have to look like a message's, so that a name that says nothing means the message;
#: of codes and statuses all have to.
MESSAGES = 0.3
#: Files whose schemas may be broadcast, if their texts aren't too long.
BROADCAST_FILES = 50_000

_KEYS = ["feed_id", "file_id"]


def promote(kinds: str) -> str:
    """SQL of the least kind of the lattice that holds all of an array of kinds, NULL for none: an integer is a decimal
    number, and everything is a string (as JSON text)."""
    return (
        f"CASE size({kinds}) WHEN 0 THEN NULL WHEN 1 THEN {kinds}[0] ELSE "
        f"IF(forall({kinds}, k -> k IN ('integer', 'decimal number')), 'decimal number', 'string') END"
    )


def _plain(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def meaning(name: Column) -> Column:
    """What a field name stands for: one of FIELDS, or the name itself without case and separators."""
    plain = _plain(name)
    found = F.lit(None).cast("string")
    for field, pattern in reversed(MEANINGS):
        found = F.when(plain.rlike(pattern), field).otherwise(found)
    return F.coalesce(found, F.nullif(plain, F.lit("")), name)


def _content(x: Column) -> Column:
    """A value out of an array of one and an object with a code."""
    one = F.when(get(x, "$[1]").isNull(), get(x, "$[0]"))
    x = F.coalesce(one, x)
    return F.coalesce(get(x, "$.code"), x)


def _looks(x: Column, schema: Column) -> dict[str, Column]:
    """Which fields a value (of _content) could belong to, for names that say nothing."""
    s, kind = get(x, "$", "string"), kind_of(x, schema)
    text = kind == "string"
    numeric = kind.isin("integer", "decimal number") | (text & F.trim(s).rlike("^[0-9]{1,8}$"))
    number = F.when(numeric, F.trim(s).try_cast("double"))
    return {
        "error_code": text & s.rlike("^[A-Z][a-z]+(?:[A-Z][a-z]*)+$"),
        "http_status_code": (number >= 100) & (number <= 599) & (number == F.floor(number)),
        "result_message": F.contains(s, F.lit("checksumAlgorithm")) & (text | (kind == "object")),
    }


def file_schemas(records: DataFrame) -> DataFrame:
    """(feed_id, file_id, written_at, schema): every file's fields in the order of their names, each with its kinds and meaning.

    Headers are read in parallel in the JVM and folded map-side to one row per task, file and field, whatever the
    number of records. A file without a single readable record has no row. A field means what its name says, and if
    that says nothing what its values look like, unless another field of the file has that name.
    """
    rows = with_object(records.select(*_KEYS, "written_at", "record"), "record", "o").drop("record")
    rows = exploded(rows, "o", "field", "x")
    opaque = ~_plain(F.col("field")).rlike("|".join(p for _, p in MEANINGS))
    rows = rows.withColumn("schema", F.schema_of_variant("x")).withColumn("y", F.when(opaque, _content(F.col("x"))))
    rows = rows.withColumn("own", F.when(F.col("y").isNotNull(), F.schema_of_variant("y")))
    kind = kind_of(F.col("x"), F.col("schema"))
    bits = F.lit(0)
    for i, k in enumerate(KINDS):
        bits = F.when(F.col("kind") == k, 1 << i).otherwise(bits)
    looks = _looks(F.col("y"), F.col("own"))
    rows = rows.select(*_KEYS, "written_at", "field", kind.alias("kind"), *(F.coalesce(c, F.lit(False)).alias(f) for f, c in looks.items()))
    heads = rows.select(*_KEYS, "written_at", "field", bits.alias("bits"), *looks)
    per_field = heads.groupBy(*_KEYS, "field").agg(
        F.max("written_at").alias("written_at"), F.bit_or("bits").alias("bits"), F.count_if(F.col("bits") > 0).alias("n"),
        *(F.count_if(f).alias(f) for f in ("error_code", "http_status_code", "result_message")),
    )
    some = F.col("n") > 0
    seen = (
        F.when(some & (F.col("http_status_code") == F.col("n")), "http_status_code")
        .when(some & (F.col("error_code") == F.col("n")), "error_code")
        .when(some & (F.col("result_message") > MESSAGES * F.col("n")), "result_message")
    )
    kinds = F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(1 << i) > 0, F.lit(k)) for i, k in enumerate(KINDS))))
    one = F.when(F.col("field").isNotNull(), F.struct("field", kinds.alias("kinds"), meaning(F.col("field")).alias("m"), seen.alias("seen")))
    files = per_field.groupBy(*_KEYS).agg(F.max("written_at").alias("written_at"), F.array_sort(F.collect_list(one)).alias("s"))
    told = "IF(x.seen IS NOT NULL AND NOT exists(s, y -> y.m = x.seen), x.seen, x.m)"
    return files.select(*_KEYS, "written_at", F.expr(f"transform(s, x -> named_struct('field', x.field, 'kinds', x.kinds, 'm', {told}))").alias("schema"))


_CHANGES = f"""
    array_sort(concat(
        transform(renamed, x -> named_struct('field', x.b.field, 'change', 'renamed', 'old_field', x.a.field, 'old', x.a.kinds, 'new', x.b.kinds)),
        transform(filter(concat(renamed, same), x -> size(x.a.kinds) > 0 AND size(x.b.kinds) > 0 AND x.a.kinds <> x.b.kinds),
                  x -> named_struct('field', x.b.field, 'change', 'retyped', 'old_field', x.a.field, 'old', x.a.kinds, 'new', x.b.kinds)),
        transform(filter(came, b -> NOT exists(gone, a -> a.m = b.m AND a.i = b.i)),
                  b -> named_struct('field', b.field, 'change', 'added', 'old_field', CAST(NULL AS STRING), 'old', CAST(array() AS ARRAY<STRING>), 'new', b.kinds)),
        transform(filter(gone, a -> NOT exists(came, b -> a.m = b.m AND a.i = b.i)),
                  a -> named_struct('field', a.field, 'change', 'removed', 'old_field', a.field, 'old', a.kinds, 'new', CAST(array() AS ARRAY<STRING>)))
    ))"""


def _ranked(a: str, b: str) -> str:
    """SQL of the fields of schema a that b lacks, with their place i among those of their meaning."""
    only = f"filter({a}, x -> NOT exists({b}, y -> y.field = x.field))"
    return f"transform({only}, x -> named_struct('field', x.field, 'kinds', x.kinds, 'm', x.m, 'i', size(filter({only}, y -> y.m = x.m AND y.field < x.field))))"


def schema_changes(records: DataFrame) -> DataFrame:
    """The ordered log of changes: feed_id, file_id, written_at, ord, field, change, old_field, old_kind, new_kind, promoted.

    Each file is compared with the file before it in its feed by (written_at, file_id); a feed's first file has no
    rows. change is added, removed, renamed or retyped; field is the name in this file, for removed the old one. A field
    whose values are all null has no kind and isn't retyped. Of names that go and names that come, those that mean
    the same are renamed, in the order of the names if there are several. promoted is the kind in the lattice that holds
    the values of both files. Records that are no JSON objects give no fields; NULL feeds are one feed; repeated
    records change nothing; other columns are ignored; an empty table gives no rows.
    """
    files = with_previous(file_schemas(records), "feed_id", "written_at", "file_id", "schema", "before").where(F.col("before").isNotNull())
    at = files.select(*_KEYS, "written_at", "schema", "before", F.expr(_ranked("schema", "before")).alias("came"), F.expr(_ranked("before", "schema")).alias("gone"))
    pair = "named_struct('a', get(filter({0}, y -> {1}), 0), 'b', x)"
    renamed = f"transform(filter(came, x -> exists(gone, y -> y.m = x.m AND y.i = x.i)), x -> {pair.format('gone', 'y.m = x.m AND y.i = x.i')})"
    same = f"transform(filter(schema, x -> exists(before, y -> y.field = x.field)), x -> {pair.format('before', 'y.field = x.field')})"
    shape = "transform({0}, x -> named_struct('a', named_struct('field', x.a.field, 'kinds', x.a.kinds), 'b', named_struct('field', x.b.field, 'kinds', x.b.kinds)))"
    at = at.withColumn("renamed", F.expr(renamed)).withColumn("same", F.expr(same))
    at = at.withColumn("renamed", F.expr(shape.format("renamed"))).withColumn("same", F.expr(shape.format("same")))
    rows = at.select(*_KEYS, "written_at", F.posexplode(F.expr(_CHANGES)).alias("ord", "c"))
    return rows.select(
        *_KEYS, "written_at", (F.col("ord") + 1).alias("ord"), "c.field", "c.change", "c.old_field",
        F.expr(promote("c.old")).alias("old_kind"), F.expr(promote("c.new")).alias("new_kind"),
        F.expr(promote("array_distinct(concat(c.old, c.new))")).alias("promoted"),
    )


def _folded(files: DataFrame) -> DataFrame:
    rows = files.select(*_KEYS, F.explode("schema").alias("f")).select(*_KEYS, "f.*")
    return rows.groupBy("m").agg(
        F.min("field").alias("field"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"),
        F.count_distinct(*_KEYS).alias("files"), F.count_distinct("field").alias("spellings"),
    )


def union_schema(records: DataFrame) -> DataFrame:
    """(meaning, field, kind, files, spellings): the schema that all files of all feeds fold into.

    One row for each meaning: its least spelling, the least kind of the lattice that holds its values everywhere (NULL if
    they are all null), the number of files that have it and of its spellings.
    """
    return _folded(file_schemas(records)).select(F.col("m").alias("meaning"), "field", F.expr(promote("kinds")).alias("kind"), "files", "spellings")


def unified_records(records: DataFrame) -> DataFrame:
    """All records in one table: feed_id, file_id, rec_no, the FIELDS of a report row, extra, err.

    What a field means is told file by file, as in schema_changes, so names that say nothing land in the column their
    values belong to. Every spelling of a field of a report row is cast to its column: codes in arrays of one or
    in objects are unwrapped, http_status_code becomes a long, result_message keeps objects as JSON text; of several
    fields of one meaning the first not null by name counts. All other fields stand in `extra`, a JSON object in the
    order of the names, cast to the kind of the union schema: where files disagree beyond numbers, all values are strings.
    So does, as it came, the value of a field whose column can't hold all of it: a code with further members, or
    a status that is no integer. Nulls have no place in it. A record that is no JSON object keeps its row with err.
    Equal records of one (feed, file, rec_no) count once; empty tables give no rows.
    """
    files = cut(file_schemas(records))
    union = _folded(files).select("m", F.expr(promote("kinds")).alias("kind"))
    fields = files.select(*_KEYS, F.explode("schema").alias("f")).select(*_KEYS, "f.field", "f.m")
    typed = fields.join(sized(union, BROADCAST_FILES, texts=True), "m", "left").groupBy(*_KEYS)
    plan = typed.agg(
        F.map_from_entries(F.collect_list(F.when((F.col("kind") == "string") & ~F.col("m").isin(*FIELDS), F.struct("field", F.lit(True))))).alias("texts"),
        *(F.array_sort(F.collect_list(F.when(F.col("m") == f, F.col("field")))).alias(f"{f}_names") for f in FIELDS),
    )
    plan = cut(plan.select(F.col("feed_id").alias("__feed"), F.col("file_id").alias("__file"), "texts", *(f"{f}_names" for f in FIELDS)))
    once = with_object(records.select(*_KEYS, "rec_no", "record").distinct(), "record", "o")
    same = F.col("feed_id").eqNullSafe(F.col("__feed")) & F.col("file_id").eqNullSafe(F.col("__file"))
    rows = once.join(sized(plan, BROADCAST_FILES, texts=True), same, "left").withColumn("all", get(F.col("o"), "$", "map<string,variant>"))
    rows = rows.withColumn("members", F.expr("map_filter(all, (n, x) -> NOT is_variant_null(x))"))
    chosen = "get(filter({0}_names, n -> map_contains_key(members, n)), 0)"
    rows = rows.select(*_KEYS, "rec_no", "members", "texts", *(F.expr(chosen.format(f)).alias(f"{f}_name") for f in FIELDS))
    values = {f: F.try_element_at("members", F.col(f"{f}_name")) for f in FIELDS}
    rows = rows.select("*", *(x.alias(f"{f}_x") for f, x in values.items()))
    # step by step, as an expression that is named twice is computed twice
    at = lambda p: {f: F.col(f"{f}_{p}") for f in FIELDS}
    rows = rows.withColumns({f"{f}_one": get(x, "$[0]") for f, x in at("x").items()})
    rows = rows.withColumns({f"{f}_y": F.when(one.isNull() | get(F.col(f"{f}_x"), "$[1]").isNotNull(), F.col(f"{f}_x")).otherwise(one) for f, one in at("one").items()})
    rows = rows.withColumns({f"{f}_code": get(y, "$.code") for f, y in at("y").items()})
    rows = rows.withColumns({f"{f}_more": code.isNotNull() & (F.size(F.map_keys(get(F.col(f"{f}_y"), "$", "map<string,variant>"))) > 1) for f, code in at("code").items()})
    rows = rows.withColumns({f"{f}_y": F.coalesce(code, F.col(f"{f}_y")) for f, code in at("code").items()})
    rows = rows.withColumns({f"{f}_text": text_of(y) for f, y in at("y").items()})
    x = F.col("result_message_x")
    rows = rows.withColumn("keep", F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    rows = rows.withColumn("result_message_text", F.when(F.col("keep"), F.to_json(x)).otherwise(F.col("result_message_text")))
    rows = rows.withColumn("status", F.trim("http_status_code_text").try_cast("bigint"))
    whole = {f: ~F.col(f"{f}_more") & text.isNotNull() for f, text in at("text").items()}
    whole["result_message"] |= F.col("keep")
    whole["http_status_code"] &= F.col("status").isNotNull()
    cols = {f: F.col("status") if f == "http_status_code" else text for f, text in at("text").items()}
    held = F.array_compact(F.array(*(F.when(whole[f], F.col(f"{f}_name")) for f in FIELDS)))
    rows = rows.select(*_KEYS, "rec_no", "members", "texts", *(c.alias(f) for f, c in cols.items()), held.alias("held"))
    extra = F.expr(
        "transform_values(map_filter(members, (n, x) -> NOT array_contains(held, n)), (n, x) -> "
        "IF(map_contains_key(texts, n) AND schema_of_variant(x) <> 'STRING', CAST(to_json(x) AS VARIANT), x))"
    )
    err = F.when(F.col("members").isNull(), F.lit("not a JSON object"))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(extra), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)))
    return rows.select(*_KEYS, "rec_no", *FIELDS, err.alias("err"), F.coalesce(F.to_json(ordered), F.lit("{}")).alias("extra"))
