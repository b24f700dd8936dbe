"""Queries of the inventory operators over whole tables, and their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from cairnframe.functions import paths
from cairnframe.functions.exec import sized, table
from cairnframe.operators import browse, compare, reuse, snapshots
from cairnframe.operators.snapshots_view import paired, side
from cairnframe.plans import consolidate, s3import
from cairnframe.sources.reports import base64_hex, decoded_key, text_or_null

KEYS = ["pair_id"]


def _sides(spark, d, noise=False, lp="", rp="", once=True):
    entries, pairs = table(spark, d, "entries"), table(spark, d, "copy_pairs")
    left = side(paths.backfill(paired(entries, pairs, "left_scan_id")), KEYS, lp, noise, once)
    return left, side(paths.backfill(paired(entries, pairs, "right_scan_id")), KEYS, rp, noise, once)


def _by_path(spark, d, noise=False, lp="", rp=""):
    return compare.compare_by_path(*_sides(spark, d, noise, lp, rp, once=False), KEYS)


def path_counts(spark, d):
    return _by_path(spark, d).groupBy("pair_id", "kind").agg(F.count(F.lit(1)).alias("files"))


def path_different(spark, d):
    rows = _by_path(spark, d).where(F.col("kind") == "different")
    return rows.select("pair_id", "rel_path", "left_size", "left_sha256", "right_size", "right_sha256")


def path_left_only(spark, d):
    return compare.only_files(_by_path(spark, d), "left", KEYS).drop("cmp")


def path_right_only(spark, d):
    return compare.only_files(_by_path(spark, d), "right", KEYS).drop("cmp")


def path_ignore_noise(spark, d):
    return _by_path(spark, d, noise=True).groupBy("pair_id", "kind").agg(F.count(F.lit(1)).alias("files"))


def path_prefix(spark, d):
    return _by_path(spark, d, lp="@eaDir", rp="/@eaDir\\").select("pair_id", "kind", "rel_path")


def path_overlap_stats(spark, d):
    return compare.overlap_stats(*_sides(spark, d, once=False), KEYS)


def _compact(spark, d, which):
    left, right = _sides(spark, d, once=False)
    rows = compare.compare_by_path(left, right, KEYS)
    only = compare.only_files(rows, which, KEYS)
    return compare.compact_missing_trees(only, right if which == "left" else left, KEYS)


def compact_left(spark, d):
    return _compact(spark, d, "left")


def compact_right(spark, d):
    return _compact(spark, d, "right")


def _snapshot_sides(spark, d):
    """The two snapshots of every step of a root: the one before is left."""
    entries, steps = table(spark, d, "entries"), snapshots.snapshot_steps(table(spark, d, "scans"))
    steps = steps.withColumnRenamed("later_scan_id", "pair_id")
    left = side(paths.backfill(paired(entries, steps.where(~F.col("is_new")), "scan_id")), KEYS, once=False)
    return left, side(paths.backfill(paired(entries, steps.where("is_new"), "scan_id")), KEYS, once=False)


def compact_removed(spark, d):
    left, right = _snapshot_sides(spark, d)
    rows = compare.compare_by_path(left, right, KEYS)
    return compare.compact_missing_trees(compare.only_files(rows, "left", KEYS), right, KEYS)


def compact_added(spark, d):
    left, right = _snapshot_sides(spark, d)
    rows = compare.compare_by_path(left, right, KEYS)
    return compare.compact_missing_trees(compare.only_files(rows, "right", KEYS), left, KEYS)


#: Folders compared with others: of other names, in other scripts, and spelled with combining accents.
REMAPS = (
    ("Ångmåla", "señales"), ("albums/Música 27/set-0498", "архив 11/Música/set-0019"),
    ("señales", unicodedata.normalize("NFD", "señales")), (unicodedata.normalize("NFD", "señales"), "señales"),
)


def path_remap(spark, d):
    """Different folders compared with each other: paths meet below their prefixes."""
    out = None
    for i, (lp, rp) in enumerate(REMAPS):
        one = _by_path(spark, d, lp=lp, rp=rp).select(F.lit(i).alias("remap"), "pair_id", "kind", "rel_path")
        out = one if out is None else out.unionByName(one)
    return out


def _contents(spark, d):
    """Both sides without the composed paths, which contents don't need."""
    entries, pairs = table(spark, d, "entries"), table(spark, d, "copy_pairs")
    return [side(paired(entries, pairs, f"{s}_scan_id"), KEYS, cmp=False) for s in ("left", "right")]


def content_identical(spark, d):
    return compare.identical_by_content(*_contents(spark, d), KEYS)


def content_left_only(spark, d):
    left, right = _contents(spark, d)
    return compare.content_excess(left, right, KEYS)


def content_right_only(spark, d):
    left, right = _contents(spark, d)
    return compare.content_excess(right, left, KEYS)


def left_only_order(spark, d):
    """The place of every file of the left side alone, by path, size and hash."""
    rows = path_left_only(spark, d).withColumn("sha256", F.coalesce("sha256", F.lit("")))
    return compare.rank_within(rows, KEYS, ["rel_path", "size", "sha256"], "place")


def content_left_order(spark, d):
    """Known contents first, each part by path."""
    return compare.rank_within(content_left_only(spark, d), KEYS, ["ord", "rel_path"], "place")


def compact_left_order(spark, d):
    """Collapsed trees stand where the first of their files would."""
    return compare.rank_within(compact_left(spark, d), KEYS, "sort_path", "place").select("pair_id", "rel_path", "place")


def duplicates_order(spark, d):
    """Every duplicate of a snapshot, the largest first."""
    return compare.rank_within(duplicates(spark, d), ["scan_id"], [F.desc("size"), "sha256", "rel_path"], "place")


def duplicate_groups(spark, d):
    """(scan_id, size, sha256, files, first, place): groups of equal files, the largest first."""
    groups = duplicates(spark, d).groupBy("scan_id", "size", "sha256").agg(F.count(F.lit(1)).alias("files"), F.min("rel_path").alias("first"))
    return compare.rank_within(groups, ["scan_id"], [F.desc("size"), "sha256"], "place")


def dirs_order(spark, d):
    return compare.rank_within(dirs_list(spark, d), ["scan_id"], "dir", "place")


def roots_order(spark, d):
    """The list of roots by hostname and root, numbered over all."""
    rows = roots_list(spark, d).select("machine_id", "root", "hostname", "current_scan_id")
    return compare.rank_within(rows.withColumn("all", F.lit(0)), ["all"], ["hostname", "root", "machine_id"], "place").drop("all")


def duplicates(spark, d):
    return browse.duplicate_files(table(spark, d, "entries"), ["scan_id"])


def duplicates_ignore_noise(spark, d):
    return browse.duplicate_files(table(spark, d, "entries"), ["scan_id"], ignore_noise=True)


def roots_list(spark, d):
    rows = browse.current_scans(table(spark, d, "roots"), table(spark, d, "scans"))
    return rows.select("machine_id", "root", "current_scan_id", "hostname", "started_at", "finished_at", "status")


def dirs_list(spark, d):
    return browse.directories(table(spark, d, "entries"), ["scan_id"])


def scan_summary(spark, d):
    return browse.scan_summary(table(spark, d, "entries"))


def interrupted_scans(spark, d):
    return browse.interrupted_scans(table(spark, d, "scans"), table(spark, d, "entries"))


def _tree(spark, d):
    rows = table(spark, d, "entries").join(table(spark, d, "scans").select("scan_id", "machine_id", "root").distinct(), "scan_id")
    return rows.select("machine_id", "root", "scan_id", "rel_path", "size", "mtime_ns", "state", "fingerprint", "sha256").distinct()


def reuse_exact(spark, d):
    """Every root's files against all of that root's other scans as candidates; the agreement rule decides."""
    rows = _tree(spark, d)
    walked = rows.select("machine_id", "root", "rel_path", "size", "mtime_ns").distinct()
    hit = reuse.reuse_hashes(walked, reuse.exact_candidates(rows, trusted_only=True), keys=["machine_id", "root"])
    return hit.where("reused").drop("reused")


def nfc_backfill(spark, d):
    return paths.backfill(table(spark, d, "entries")).select("scan_id", "rel_path", "rel_path_norm").distinct()


def name_parts(spark, d):
    p = F.col("rel_path")
    rows = table(spark, d, "entries").select("rel_path").distinct()
    return rows.select("rel_path", paths.base_name(p).alias("base"), paths.extension(paths.base_name(p)).alias("ext"), F.size(paths.ancestors(p)).cast("long").alias("depth"))


def exclude_patterns(spark, d):
    rows = table(spark, d, "entries")
    return rows.where(~paths.excluded(F.col("rel_path"), ["Thumbs.db", ".DS_Store", "@eaDir/", "tapes/"])).select("scan_id", "rel_path").distinct()


def _current(spark, d):
    """Entries of the current scans with machine and root, each once."""
    roots = table(spark, d, "roots").where("current_scan_id is not null").distinct()
    rows = table(spark, d, "entries").join(roots.withColumnRenamed("current_scan_id", "scan_id"), "scan_id")
    return rows.select("machine_id", "root", "rel_path", "size", "mtime_ns", "state", "fingerprint", "sha256").distinct()


def _nested(rows):
    """The rows of every top folder as a root of its own."""
    top = F.substring_index("rel_path", "/", 1)
    inside = rows.where(F.contains("rel_path", F.lit("/"))).withColumn("root", F.concat("root", F.lit("/"), top))
    return inside.withColumn("rel_path", F.substring("rel_path", F.length(top) + 2, F.length("rel_path")))


def root_overlaps(spark, d):
    """Roots and their top folders: which is the same as, above or below which."""
    rows = _current(spark, d)
    all_ = table(spark, d, "roots").select("machine_id", "root").unionByName(_nested(rows).select("machine_id", "root"))
    return reuse.root_pairs(all_)


def reuse_overlap(spark, d):
    """Hashes that a scan of a root can take from roots above and below it, with every top folder as a root too."""
    rows = _current(spark, d)
    both = rows.unionByName(_nested(rows))
    pairs = reuse.root_pairs(both).withColumnRenamed("other", "target")
    found = reuse.agreed(reuse.rebased(both, pairs, ["machine_id"]), ["machine_id", "target"])
    return found.where("agree").drop("agree")


def reuse_authority(spark, d):
    """Every root's files against its current scan in any state and its newest failed scan where that can be trusted."""
    rows, scans = _tree(spark, d), table(spark, d, "scans")
    current = table(spark, d, "roots").select(F.col("current_scan_id").alias("scan_id")).dropna().distinct()
    failed = scans.where("status = 'failed'").groupBy("machine_id", "root").agg(F.max("scan_id").alias("scan_id")).select("scan_id")
    exact = reuse.exact_candidates(rows.join(current, "scan_id")).unionByName(reuse.exact_candidates(rows.join(failed, "scan_id"), trusted_only=True))
    walked = rows.select("machine_id", "root", "rel_path", "size", "mtime_ns").distinct()
    return reuse.reuse_hashes(walked, exact, keys=["machine_id", "root"])


def _report(spark, d):
    """Loaded report rows, each once, and the markers that a console leaves for every folder."""
    rows = table(spark, d, "s3_report_rows").distinct()
    folder = F.regexp_extract("object_key", "^(.*/)", 1)
    cols = {"object_key": F.col("folder"), "usable": F.lit(1), "task_status": F.lit("succeeded")}
    dirs = rows.select("import_id", "bucket", folder.alias("folder")).where("folder <> ''").distinct()
    marks = dirs.select(*(cols.get(f.name, F.col(f.name) if f.name in dirs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema))
    return rows.unionByName(marks)


def _objects(spark, d):
    """Objects as an inventory has them: those of the buckets' scans without a version, those of report rows with theirs."""
    rows = table(spark, d, "s3_report_rows").distinct()
    scans = table(spark, d, "scans").where("machine_id = 's3'").select("scan_id", F.expr("substring(root, 6)").alias("bucket")).distinct()
    plain = table(spark, d, "entries").join(scans, "scan_id").select(
        "bucket", F.col("rel_path").alias("key"), F.lit("").alias("version"), "size", "mtime_ns", F.struct(F.lit(1).alias("a"), F.col("scan_id").alias("b"), F.col("mtime_ns").alias("c"), F.col("size").alias("d")).alias("ord"),
    )
    versions = rows.where("version_id is not null").select(
        "bucket", F.col("object_key").alias("key"), F.col("version_id").alias("version"), (F.col("row_index") * 10).cast("long").alias("size"), F.col("import_id").alias("mtime_ns"),
        F.struct(F.lit(0).alias("a"), F.col("import_id").alias("b"), F.col("row_index").cast("long").alias("c"), F.lit(0).cast("long").alias("d")).alias("ord"),
    )
    return plain.unionByName(versions)


def s3_versions(spark, d):
    """The size of every object by version and without one."""
    return s3import.lookup_table(_objects(spark, d))


def s3_inventory_lookup(spark, d):
    """Report rows with size and mtime: by version, then without one."""
    rows = table(spark, d, "s3_report_rows").distinct()
    return s3import.with_metadata(rows, s3import.lookup_table(_objects(spark, d))).select("import_id", "row_index", "size", "mtime_ns", "sized")


def _sized_report(spark, d):
    return s3import.with_markers(s3import.with_metadata(_report(spark, d), s3import.lookup_table(_objects(spark, d))))


def s3_counters(spark, d):
    return s3import.counters(_sized_report(spark, d))


def s3_buckets(spark, d):
    """Every bucket of an import with its number of entries."""
    return s3import.bucket_summaries(_sized_report(spark, d), ["import_id"])


def s3_times(spark, d):
    """Times of an inventory in the forms that occur, in nanoseconds."""
    at = table(spark, d, "documents").where("received_at is not null")
    forms = {"z": "yyyy-MM-dd'T'HH:mm:ss'Z'", "blank": "yyyy-MM-dd HH:mm:ss", "ms": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "offset": "yyyy-MM-dd'T'HH:mm:ss'+05:30'", "none": "dd/MM/yyyy"}
    texts = at.select("doc_id", F.explode(F.create_map(*(x for n, f in forms.items() for x in (F.lit(n), F.date_format("received_at", f))))).alias("form", "text"))
    return texts.select("doc_id", "form", s3import.timestamp_ns(F.col("text")).alias("ns"))


def s3_values(spark, d):
    rows = table(spark, d, "s3_report_rows").distinct()
    return rows.select(
        "import_id", "row_index", decoded_key(F.col("object_key")).alias("key"), text_or_null(F.col("version_id")).alias("version"),
        base64_hex(F.col("checksum_base64")).alias("hex64"),
    )


def s3_duplicate_keys(spark, d):
    """Objects that an import would refuse, if every versioned object were reported without its version too."""
    rows = table(spark, d, "s3_report_rows")
    bare = rows.where("version_id is not null").withColumn("version_id", F.lit(None).cast("string"))
    return s3import.duplicate_keys(rows.unionByName(bare), ["import_id"])


def s3_entries(spark, d):
    return s3import.entries_of(table(spark, d, "s3_report_rows"))


def consolidate_last_wins(spark, d):
    """Every complete scan as a fragment whose name says nothing of its time; of every root the last fragment by name stays."""
    scans = table(spark, d, "scans").where("status = 'complete'").distinct()
    tagged = scans.select("machine_id", "root", "scan_id", F.reverse(F.col("scan_id").cast("string")).alias("fragment"))
    return consolidate.last_wins(tagged, ["machine_id", "root"], "fragment")


def merge_stores(spark, d):
    """A store in which the first complete scan of every root is current, merged into the given one: its entries by scan."""
    t = {n: table(spark, d, n).distinct() for n in ("roots", "scans", "entries")}
    first = t["scans"].where("status = 'complete'").groupBy("machine_id", "root").agg(F.min("scan_id").alias("current_scan_id"))
    source = consolidate.renumber({"roots": first, "scans": t["scans"], "entries": t["entries"]}, 1_000_000_000)
    merged = consolidate.merge(t, source)
    files = merged["entries"].groupBy("scan_id").agg(F.count_distinct("rel_path").alias("files"))
    scans = merged["scans"].select("scan_id", "machine_id", "root").distinct()
    now = merged["roots"].select(F.col("current_scan_id").alias("scan_id"), F.lit(True).alias("current"))
    return files.join(scans, "scan_id").join(now, "scan_id", "left").select("scan_id", "machine_id", "root", "files", F.coalesce("current", F.lit(False)).alias("current"))


def delete_machine(spark, d):
    kept = consolidate.without_machines({"roots": table(spark, d, "roots"), "scans": table(spark, d, "scans"), "entries": table(spark, d, "entries")}, ["s3", ""])
    return kept["entries"].groupBy("scan_id").agg(F.count(F.lit(1)).alias("rows"))


def import_current(spark, d):
    """What a merge takes over: the complete scans that roots point to, with their number of entries."""
    t = {n: table(spark, d, n) for n in ("roots", "scans", "entries")}
    return consolidate.current_only(t)["entries"].groupBy("scan_id").agg(F.count_distinct("rel_path").alias("files"))


def upsert_roots(spark, d):
    roots, scans = table(spark, d, "roots"), table(spark, d, "scans")
    fresh = scans.where("status = 'complete'").groupBy("machine_id", "root").agg(F.max_by("scan_id", F.struct("started_at", "scan_id")).alias("current_scan_id"))
    return consolidate.upsert(roots.distinct(), fresh, ["machine_id", "root"])


def fingerprint_texts(spark, d):
    docs = table(spark, d, "documents")
    from cairnframe.functions.hashing import fingerprint

    return docs.where("text is not null").select("doc_id", fingerprint(F.encode("text", "UTF-8")).alias("fp"), F.sha2("text", 256).alias("sha"))


QUERIES = {
    f.__name__: f
    for f in (
        path_counts, path_different, path_left_only, path_right_only, path_ignore_noise, path_prefix, path_remap, path_overlap_stats,
        compact_left, compact_right, compact_removed, compact_added, content_identical, content_left_only, content_right_only, duplicates,
        duplicates_ignore_noise, duplicate_groups, left_only_order, content_left_order, compact_left_order, duplicates_order, dirs_order, roots_order,
        roots_list, dirs_list, scan_summary, interrupted_scans, reuse_exact, reuse_authority, reuse_overlap, root_overlaps, nfc_backfill,
        name_parts, exclude_patterns, s3_counters, s3_buckets, s3_values, s3_duplicate_keys, s3_entries, s3_versions, s3_inventory_lookup, s3_times,
        consolidate_last_wins, merge_stores, delete_machine, import_current, upsert_roots, fingerprint_texts,
    )
}

_NOISE = """(lower(name) IN ('.ds_store', 'thumbs.db', 'ehthumbs.db', 'desktop.ini', '.directory')
             OR starts_with(lower(rel_path), '@eadir/') OR contains(lower(rel_path), '/@eadir/'))"""


_PAIRS = tuple(f"SELECT DISTINCT pair_id, {c} AS scan_id FROM copy_pairs" for c in ("left_scan_id", "right_scan_id"))
_STEP = """SELECT scan_id AS later, lag(scan_id) OVER (PARTITION BY machine_id, root ORDER BY started_at, scan_id) AS before
    FROM (SELECT DISTINCT scan_id, machine_id, root, started_at FROM scans WHERE status = 'complete')"""
_STEPS = tuple(f"SELECT later AS pair_id, {c} AS scan_id FROM ({_STEP}) WHERE before IS NOT NULL" for c in ("before", "later"))


def _sides_sql(where: str = "true", lp: str = "", rp: str = "", pairs: tuple[str, str] = _PAIRS) -> str:
    def one(source: str, p: str) -> str:
        return f"""SELECT DISTINCT pair_id, substr(rel_path, {len(p) + 1}) AS rel_path,
            substr(coalesce(nullif(rel_path_norm, ''), nfc_normalize(rel_path)), {len(unicodedata.normalize("NFC", p)) + 1}) AS cmp, size,
            lower(nullif(sha256, '')) AS sha FROM entries JOIN ({source}) USING (scan_id)
            WHERE starts_with(rel_path, '{p}') AND {where}"""

    return f"l AS ({one(pairs[0], lp)}), r AS ({one(pairs[1], rp)})"


_PATH = """j AS (SELECT coalesce(l.pair_id, r.pair_id) AS pair_id, coalesce(l.rel_path, r.rel_path) AS rel_path,
        coalesce(l.cmp, r.cmp) AS cmp, l.pair_id IS NOT NULL AS il, r.pair_id IS NOT NULL AS ir, l.size AS ls, l.sha AS lh,
        r.size AS rs, r.sha AS rh FROM l FULL JOIN r ON l.pair_id = r.pair_id AND l.rel_path = r.rel_path),
    rest AS (SELECT *, count(*) FILTER (il) OVER (PARTITION BY pair_id, cmp) AS nl,
             count(*) FILTER (ir) OVER (PARTITION BY pair_id, cmp) AS nr FROM j WHERE il <> ir),
    two AS (SELECT a.pair_id, a.cmp AS rel_path, a.cmp, a.ls, a.lh, b.rs, b.rh FROM rest a JOIN rest b
            ON a.pair_id = b.pair_id AND a.cmp = b.cmp AND a.il AND b.ir AND a.nl = 1 AND a.nr = 1),
    c AS (SELECT pair_id, rel_path, cmp, ls, lh, rs, rh, CASE WHEN ls = rs AND lh = rh THEN 'identical' ELSE 'different' END
          AS kind FROM (SELECT pair_id, rel_path, cmp, ls, lh, rs, rh FROM j WHERE il AND ir UNION ALL SELECT * FROM two)
          UNION ALL SELECT pair_id, rel_path, cmp, ls, lh, rs, rh, CASE WHEN il THEN 'left_only' ELSE 'right_only' END
          FROM rest WHERE NOT (nl = 1 AND nr = 1))"""

_ANC = "list_transform(range(1, len(string_split({0}, '/'))), lambda i: array_to_string(list_slice(string_split({0}, '/'), 1, i), '/'))"


def _compact_sql(which: str, pairs: tuple[str, str] = _PAIRS) -> str:
    other, size, sha = ("r", "ls", "lh") if which == "left" else ("l", "rs", "rh")
    return f"""WITH {_sides_sql(pairs=pairs)}, {_PATH},
    o AS (SELECT pair_id, rel_path, cmp, {size} AS size, {sha} AS sha FROM c WHERE kind = '{which}_only'),
    x AS (SELECT pair_id, rel_path, unnest({_ANC.format('rel_path')}) AS dir, unnest({_ANC.format('cmp')}) AS cdir FROM o),
    nodes AS (SELECT DISTINCT pair_id, unnest(list_append({_ANC.format('cmp')}, cmp)) AS cdir FROM {other}),
    dirs AS (SELECT pair_id, dir, cdir, count(*) AS n FROM x GROUP BY ALL HAVING count(*) >= 2),
    free AS (SELECT * FROM dirs ANTI JOIN nodes USING (pair_id, cdir)),
    t AS (SELECT pair_id, rel_path, min_by(dir, length(dir)) AS dir, min_by(n, length(dir)) AS n
          FROM x JOIN free USING (pair_id, dir) GROUP BY 1, 2)
    SELECT pair_id, dir || '/*' AS rel_path, max(n) AS file_count, true AS collapsed, CAST(0 AS BIGINT) AS size, '' AS sha256,
           min(rel_path) AS sort_path FROM t GROUP BY pair_id, dir
    UNION ALL SELECT pair_id, rel_path, 1, false, size, coalesce(sha, ''), rel_path FROM o ANTI JOIN t USING (pair_id, rel_path)"""


def _excess_sql(a: str, b: str) -> str:
    return f"""WITH {_sides_sql()},
    m AS (SELECT pair_id, sha, count(*) AS n FROM {b} WHERE sha IS NOT NULL GROUP BY 1, 2),
    x AS (SELECT *, row_number() OVER (PARTITION BY pair_id, sha ORDER BY rel_path) AS rn FROM {a} WHERE sha IS NOT NULL)
    SELECT x.pair_id, x.rel_path, x.size, x.sha AS sha256, 0 AS ord FROM x LEFT JOIN m USING (pair_id, sha)
    WHERE rn > coalesce(n, 0)
    UNION ALL SELECT pair_id, rel_path, size, '', 1 FROM {a} WHERE sha IS NULL"""


def _dup_sql(where: str) -> str:
    return f"""WITH e AS (SELECT DISTINCT scan_id, size, lower(sha256) AS sha256, rel_path FROM entries
        WHERE sha256 <> '' AND {where})
    SELECT * FROM e SEMI JOIN (SELECT scan_id, size, sha256 FROM e GROUP BY ALL HAVING count(*) >= 2) g
    USING (scan_id, size, sha256)"""


_CURRENT = """cur AS (SELECT DISTINCT machine_id, root, rel_path, size, mtime_ns, state, fingerprint, sha256 FROM entries
        JOIN (SELECT DISTINCT * FROM roots) r ON r.current_scan_id = entries.scan_id),
    nested AS (SELECT machine_id, root || '/' || split_part(rel_path, '/', 1) AS root, substr(rel_path, length(split_part(rel_path, '/', 1)) + 2) AS rel_path,
               size, mtime_ns, state, fingerprint, sha256 FROM cur WHERE contains(rel_path, '/'))"""
_OBJECTS = """rep AS (SELECT DISTINCT * FROM s3_report_rows), sc AS (SELECT DISTINCT scan_id, substr(root, 6) AS bucket FROM scans WHERE machine_id = 's3'),
    plain AS (SELECT bucket, rel_path AS key, max_by({'size': size, 'mtime_ns': mtime_ns}, {'s': scan_id, 'm': mtime_ns, 'z': size}) AS v
              FROM entries JOIN sc USING (scan_id) GROUP BY 1, 2),
    vers AS (SELECT bucket, object_key AS key, version_id AS version, row_index, import_id FROM rep WHERE version_id IS NOT NULL),
    lookup AS (SELECT bucket, key, '' AS version, v.size AS size, v.mtime_ns AS mtime_ns FROM plain
        UNION ALL SELECT bucket, key, version, CAST(arg_max(row_index, {'i': import_id, 'r': row_index}) AS BIGINT) * 10, max(import_id) FROM vers GROUP BY 1, 2, 3
        UNION ALL SELECT bucket, key, '', CAST(arg_min(row_index, {'i': import_id, 'r': row_index}) AS BIGINT) * 10, min(import_id)
        FROM vers ANTI JOIN plain USING (bucket, key) GROUP BY 1, 2)"""
_REPORT = """y AS (SELECT import_id, bucket, object_key, version_id, coalesce(lower(task_status), '') = 'succeeded' AS done, usable FROM rep
        UNION ALL SELECT DISTINCT import_id, bucket, regexp_extract(object_key, '^(.*/)', 1), NULL, true, 1 FROM rep WHERE contains(object_key, '/')),
    z AS (SELECT y.*, v.bucket IS NOT NULL OR n.bucket IS NOT NULL AS found, usable = 1 AND ends_with(object_key, '/')
              AND coalesce(v.size, n.size, 0) = 0 AS marker FROM y
          LEFT JOIN lookup v ON v.bucket = y.bucket AND v.key = object_key AND v.version = version_id
          LEFT JOIN lookup n ON n.bucket = y.bucket AND n.key = object_key AND n.version = '')"""

SQL = {
    "path_counts": f"WITH {_sides_sql()}, {_PATH} SELECT pair_id, kind, count(*) AS files FROM c GROUP BY 1, 2",
    "path_different": f"""WITH {_sides_sql()}, {_PATH} SELECT pair_id, rel_path, ls AS left_size, lh AS left_sha256,
        rs AS right_size, rh AS right_sha256 FROM c WHERE kind = 'different'""",
    "path_left_only": f"""WITH {_sides_sql()}, {_PATH} SELECT pair_id, rel_path, ls AS size, lh AS sha256 FROM c
        WHERE kind = 'left_only'""",
    "path_right_only": f"""WITH {_sides_sql()}, {_PATH} SELECT pair_id, rel_path, rs AS size, rh AS sha256 FROM c
        WHERE kind = 'right_only'""",
    "path_ignore_noise": f"""WITH {_sides_sql('NOT ' + _NOISE)}, {_PATH} SELECT pair_id, kind, count(*) AS files
        FROM c GROUP BY 1, 2""",
    "path_prefix": f"WITH {_sides_sql(lp='@eaDir/', rp='@eaDir/')}, {_PATH} SELECT pair_id, kind, rel_path FROM c",
    "path_overlap_stats": f"""WITH {_sides_sql()}, {_PATH} SELECT pair_id, count(*) FILTER (il) AS left_rows,
        count(*) FILTER (ir) AS right_rows, count(*) FILTER (il AND ir) AS exact_matches FROM j GROUP BY 1""",
    "compact_left": _compact_sql("left"),
    "compact_right": _compact_sql("right"),
    "compact_removed": _compact_sql("left", _STEPS),
    "compact_added": _compact_sql("right", _STEPS),
    "content_identical": f"""WITH {_sides_sql()},
        a AS (SELECT pair_id, sha, count(*) AS n FROM l WHERE sha IS NOT NULL GROUP BY 1, 2),
        b AS (SELECT pair_id, sha, count(*) AS m FROM r WHERE sha IS NOT NULL GROUP BY 1, 2)
        SELECT pair_id, CAST(sum(least(n, m)) AS BIGINT) AS identical FROM a JOIN b USING (pair_id, sha) GROUP BY 1""",
    "content_left_only": _excess_sql("l", "r"),
    "content_right_only": _excess_sql("r", "l"),
    "duplicates": _dup_sql("true"),
    "duplicates_ignore_noise": _dup_sql("NOT " + _NOISE),
    "roots_list": """SELECT DISTINCT r.machine_id, r.root, r.current_scan_id, s.hostname, s.started_at, s.finished_at, s.status
        FROM roots r JOIN scans s ON s.scan_id = r.current_scan_id""",
    "dirs_list": f"SELECT DISTINCT scan_id, unnest({_ANC.format('rel_path')}) AS dir FROM entries",
    "scan_summary": """SELECT scan_id, state, count(*) AS files FROM (SELECT DISTINCT scan_id, rel_path,
        coalesce(nullif(state, ''), 'unknown') AS state FROM entries) GROUP BY 1, 2""",
    "interrupted_scans": """WITH f AS (SELECT machine_id, root, max(scan_id) AS scan_id FROM scans WHERE status = 'failed'
        GROUP BY 1, 2), g AS (SELECT DISTINCT scan_id, rel_path FROM entries WHERE state IN ('ok', 'reused') AND sha256 <> '')
        SELECT f.machine_id, f.root, f.scan_id, count(rel_path) AS reusable FROM f LEFT JOIN g USING (scan_id) GROUP BY ALL""",
    "reuse_exact": """WITH e AS (SELECT DISTINCT machine_id, root, rel_path, size, mtime_ns, state, coalesce(fingerprint, '') AS f,
        coalesce(sha256, '') AS h FROM entries JOIN (SELECT DISTINCT scan_id, machine_id, root FROM scans) USING (scan_id))
        SELECT machine_id, root, rel_path, size, mtime_ns, nullif(min(f), '') AS fingerprint, nullif(min(h), '') AS sha256
        FROM e WHERE state IN ('ok', 'reused') GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT (f, h)) = 1""",
    "nfc_backfill": """SELECT DISTINCT scan_id, rel_path, coalesce(nullif(rel_path_norm, ''),
        nullif(nfc_normalize(rel_path), rel_path)) AS rel_path_norm FROM entries""",
    "name_parts": """SELECT DISTINCT rel_path, list_last(string_split(rel_path, '/')) AS base,
        lower(regexp_extract(list_last(string_split(rel_path, '/')), '(\\.[^.]*)$', 1)) AS ext,
        CAST(len(string_split(rel_path, '/')) - 1 AS BIGINT) AS depth FROM entries""",
    "exclude_patterns": """SELECT DISTINCT scan_id, rel_path FROM entries
        WHERE list_last(string_split(rel_path, '/')) NOT IN ('Thumbs.db', '.DS_Store')
        AND NOT contains('/' || rel_path, '/@eaDir/') AND NOT contains('/' || rel_path, '/tapes/')""",
    "root_overlaps": f"""WITH {_CURRENT}, r AS (SELECT machine_id, root FROM roots UNION SELECT machine_id, root FROM nested)
        SELECT machine_id, a.root, b.root AS other, CASE WHEN a.root = b.root THEN 'same' WHEN starts_with(b.root, a.root || '/')
        THEN 'ancestor' ELSE 'descendant' END AS how FROM r a JOIN r b USING (machine_id)
        WHERE a.root = b.root OR starts_with(b.root, a.root || '/') OR starts_with(a.root, b.root || '/')""",
    "reuse_overlap": f"""WITH {_CURRENT}, b AS (SELECT * FROM cur UNION SELECT * FROM nested), r AS (SELECT DISTINCT machine_id, root AS target FROM b),
        x AS (SELECT machine_id, target, substr(root || '/' || rel_path, length(target) + 2) AS rel_path, size, mtime_ns, fingerprint, sha256
              FROM b JOIN r USING (machine_id) WHERE root <> target AND starts_with(root || '/' || rel_path, target || '/')
              AND (starts_with(root, target || '/') OR starts_with(target, root || '/'))
              AND state IN ('ok', 'reused') AND fingerprint <> '' AND sha256 <> '')
        SELECT machine_id, target, rel_path, size, mtime_ns, min(fingerprint) AS fingerprint, min(sha256) AS sha256 FROM x
        GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT (fingerprint, sha256)) = 1""",
    "reuse_authority": """WITH e AS (SELECT DISTINCT scan_id, machine_id, root, rel_path, size, mtime_ns, state, coalesce(fingerprint, '') AS f,
            coalesce(sha256, '') AS h FROM entries JOIN (SELECT DISTINCT scan_id, machine_id, root FROM scans) USING (scan_id)),
        x AS (SELECT * FROM e WHERE scan_id IN (SELECT current_scan_id FROM roots) UNION ALL SELECT * FROM e WHERE state IN ('ok', 'reused')
              AND scan_id IN (SELECT max(scan_id) FROM scans WHERE status = 'failed' GROUP BY machine_id, root)),
        a AS (SELECT machine_id, root, rel_path, size, mtime_ns, min(f) AS f, min(h) AS h FROM x GROUP BY ALL HAVING count(DISTINCT (f, h)) = 1),
        w AS (SELECT DISTINCT machine_id, root, rel_path, size, mtime_ns FROM e)
        SELECT w.*, f IS NOT NULL AS reused, nullif(f, '') AS fingerprint, nullif(h, '') AS sha256 FROM w
        LEFT JOIN a USING (machine_id, root, rel_path, size, mtime_ns)""",
    "path_remap": " UNION ALL ".join(
        f"SELECT * FROM (WITH {_sides_sql(lp=lp + '/', rp=rp + '/')}, {_PATH} SELECT {i} AS remap, pair_id, kind, rel_path FROM c)" for i, (lp, rp) in enumerate(REMAPS)
    ),
    "left_only_order": f"""WITH {_sides_sql()}, {_PATH} SELECT pair_id, rel_path, ls AS size, coalesce(lh, '') AS sha256,
        row_number() OVER (PARTITION BY pair_id ORDER BY rel_path, ls, coalesce(lh, '')) AS place FROM c WHERE kind = 'left_only'""",
    "content_left_order": f"""SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ord, rel_path) AS place FROM ({_excess_sql("l", "r")})""",
    "compact_left_order": f"SELECT pair_id, rel_path, row_number() OVER (PARTITION BY pair_id ORDER BY sort_path) AS place FROM ({_compact_sql('left')})",
    "duplicates_order": f"""SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY size DESC, sha256, rel_path) AS place FROM ({_dup_sql("true")})""",
    "duplicate_groups": f"""SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY size DESC, sha256) AS place FROM
        (SELECT scan_id, size, sha256, count(*) AS files, min(rel_path) AS first FROM ({_dup_sql("true")}) GROUP BY 1, 2, 3)""",
    "dirs_order": f"""SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY dir) AS place FROM
        (SELECT DISTINCT scan_id, unnest({_ANC.format('rel_path')}) AS dir FROM entries)""",
    "roots_order": """SELECT DISTINCT machine_id, root, hostname, current_scan_id, dense_rank() OVER (ORDER BY hostname, root, machine_id) AS place
        FROM (SELECT DISTINCT r.machine_id, r.root, s.hostname, r.current_scan_id FROM roots r JOIN scans s ON s.scan_id = r.current_scan_id)""",
    "s3_versions": f"WITH {_OBJECTS} SELECT * FROM lookup",
    "s3_inventory_lookup": f"""WITH {_OBJECTS} SELECT r.import_id, r.row_index, coalesce(v.size, n.size) AS size, coalesce(v.mtime_ns, n.mtime_ns) AS mtime_ns,
        v.bucket IS NOT NULL OR n.bucket IS NOT NULL AS sized FROM (SELECT DISTINCT * FROM s3_report_rows) r
        LEFT JOIN lookup v ON v.bucket = r.bucket AND v.key = r.object_key AND v.version = r.version_id
        LEFT JOIN lookup n ON n.bucket = r.bucket AND n.key = r.object_key AND n.version = ''""",
    "s3_counters": f"""WITH {_OBJECTS}, {_REPORT}
        SELECT import_id, count(*) AS rows_total, count(*) FILTER (done) AS rows_succeeded, count(*) FILTER (usable = 1 AND NOT marker) AS rows_usable,
            count(*) FILTER (NOT done) AS rows_failed, count(*) FILTER (done AND usable = 0) AS rows_unsupported,
            count(*) FILTER (usable = 1 AND found AND NOT marker) AS rows_with_size, count(*) FILTER (marker) AS rows_folder_markers,
            count(DISTINCT bucket) AS buckets FROM z GROUP BY 1""",
    "s3_buckets": f"""WITH {_OBJECTS}, {_REPORT} SELECT import_id, bucket, 's3://' || bucket AS root, count(*) FILTER (usable = 1 AND NOT marker) AS entries
        FROM z GROUP BY 1, 2""",
    "s3_times": """WITH d AS (SELECT doc_id, received_at AS t FROM documents WHERE received_at IS NOT NULL)
        SELECT doc_id, 'z' AS form, epoch_ns(date_trunc('second', t)) AS ns FROM d UNION ALL SELECT doc_id, 'blank', epoch_ns(date_trunc('second', t)) FROM d
        UNION ALL SELECT doc_id, 'ms', epoch_ns(date_trunc('millisecond', t)) FROM d UNION ALL SELECT doc_id, 'none', 0 FROM d
        UNION ALL SELECT doc_id, 'offset', epoch_ns(date_trunc('second', t)) - 19800000000000 FROM d""",
    "merge_stores": """WITH f AS (SELECT machine_id, root, min(scan_id) AS s FROM scans WHERE status = 'complete' GROUP BY 1, 2),
        n AS (SELECT scan_id, count(DISTINCT rel_path) AS files FROM entries GROUP BY 1),
        old AS (SELECT DISTINCT scan_id, machine_id, root FROM scans ANTI JOIN f USING (machine_id, root))
        SELECT scan_id + 1000000000 AS scan_id, machine_id, root, files, true AS current FROM f JOIN n ON n.scan_id = f.s
        UNION ALL SELECT scan_id, machine_id, root, files, EXISTS (SELECT 1 FROM roots r WHERE r.current_scan_id = old.scan_id) FROM old JOIN n USING (scan_id)""",
    "s3_values": """SELECT import_id, row_index, coalesce(url_decode(replace(object_key, '+', '%20')), object_key) AS key,
        CASE WHEN lower(trim(version_id)) NOT IN ('', 'null') THEN trim(version_id) END AS version,
        lower(hex(from_base64(checksum_base64))) AS hex64 FROM (SELECT DISTINCT * FROM s3_report_rows)""",
    "s3_duplicate_keys": """SELECT import_id, bucket, object_key, count(*) AS copies FROM (SELECT * FROM s3_report_rows
        UNION SELECT * REPLACE (NULL AS version_id) FROM s3_report_rows WHERE version_id IS NOT NULL)
        WHERE usable = 1 GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "s3_entries": """SELECT DISTINCT import_id, bucket, object_key AS rel_path, list_last(string_split(object_key, '/')) AS name,
        lower(regexp_extract(list_last(string_split(object_key, '/')), '(\\.[^.]*)$', 1)) AS ext, lower(checksum_hex) AS sha256
        FROM s3_report_rows WHERE usable = 1""",
    "consolidate_last_wins": """SELECT machine_id, root, arg_max(scan_id, reverse(scan_id::VARCHAR)) AS scan_id, max(reverse(scan_id::VARCHAR)) AS fragment
        FROM scans WHERE status = 'complete' GROUP BY 1, 2""",
    "delete_machine": """SELECT scan_id, count(*) AS rows FROM entries WHERE scan_id NOT IN
        (SELECT scan_id FROM scans WHERE machine_id = 's3') GROUP BY 1""",
    "import_current": """SELECT scan_id, count(DISTINCT rel_path) AS files FROM entries WHERE scan_id IN
        (SELECT s.scan_id FROM scans s JOIN roots r ON r.current_scan_id = s.scan_id AND r.machine_id = s.machine_id
         AND r.root = s.root) GROUP BY 1""",
    "upsert_roots": """WITH f AS (SELECT machine_id, root, arg_max(scan_id, (started_at, scan_id)) AS current_scan_id FROM scans
        WHERE status = 'complete' GROUP BY 1, 2)
        SELECT * FROM f UNION ALL SELECT DISTINCT * FROM roots ANTI JOIN f USING (machine_id, root)""",
    "fingerprint_texts": """WITH t AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents
        WHERE text IS NOT NULL)
        SELECT doc_id, sha256(array_slice(b, 1, 65536) || array_slice(b, greatest(n - 65535, 1), n)
            || unhex(array_to_string(list_reverse(regexp_extract_all(printf('%016x', n), '..')), ''))) AS fp, sha256(b) AS sha
        FROM t""",
}
