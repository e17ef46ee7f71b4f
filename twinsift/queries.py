"""The registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions.content import content_digest, file_digest
from twinsift.functions.text import base_name, format_bytes, parsed_extension, suffix, windows_path
from twinsift.operators import filters, groups
from twinsift.operators.refine import compare_files, compare_pairs_of_files
from twinsift.plans import disposal, matches, report
from twinsift.plans.numbering import number_rows
from twinsift.schema import SMALL_BYTES
from twinsift.scratch import new_folder, written
from twinsift.sources.flatdir import listed, scan_folders
from twinsift.sources.index import changes, decode_row, encode_row, read_index, read_kept, write_index, write_parquet_index
from twinsift.sources.objects import equal_objects
from twinsift.sources.tables import as_folder, as_folders, documents_as_files, documents_as_paths

Query = Callable[[SparkSession, str], DataFrame]
_SHOWN = ("path", "size", "mtime", "dev", "ino")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_files(_table(spark, sf_dir, "documents"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_paths(_table(spark, sf_dir, "documents"))


def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.collapse_links(files(spark, sf_dir))


def collapsed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collapsed() as a table, for queries that look at it more than once."""
    return written(collapsed(spark, sf_dir), "collapsed")


def scan_ext_filter(spark, sf_dir):
    return filters.with_extensions(files(spark, sf_dir), [".en", ".de"]).select(*_SHOWN)


def size_sort_rank(spark, sf_dir):
    return number_rows(paths(spark, sf_dir).select("path", "size"), ["size", "path"], "place")


def size_collisions(spark, sf_dir):
    return groups.colliding(paths(spark, sf_dir), ["size"])


def size_semi(spark, sf_dir):
    return groups.in_collisions(paths(spark, sf_dir), ["size"]).select("path", "size")


def collapse_hardlinks(spark, sf_dir):
    return collapsed(spark, sf_dir).select(*_SHOWN)


def full_digest(spark, sf_dir):
    return files(spark, sf_dir).select("path", "size", "digest")


def sample_digest(spark, sf_dir):
    return documents_as_files(_table(spark, sf_dir, "documents"), sample=True).select("path", "size", "sample")


def sample_groups(spark, sf_dir):
    docs = documents_as_files(_table(spark, sf_dir, "documents"), sample=True)
    return groups.colliding(groups.collapse_links(docs).filter(F.col("size") > SMALL_BYTES), ["size", "sample"])


def digest_groups(spark, sf_dir):
    return groups.colliding(collapsed(spark, sf_dir), ["size", "digest"])


def strategy_tier(spark, sf_dir):
    return groups.strategy_tiers(files(spark, sf_dir))


def pair_compare(spark, sf_dir):
    return groups.compare_pairs(collapsed(spark, sf_dir))


def dup_members(spark, sf_dir):
    return groups.in_collisions(collapsed_once(spark, sf_dir), ["size", "digest"]).select("path", "size", "digest")


def report_groups(spark, sf_dir):
    return report.report_groups(collapsed(spark, sf_dir)).select("group_no", "size", "copies", "wasted")


def report_members(spark, sf_dir):
    return report.report_members(collapsed_once(spark, sf_dir))


def report_lines(spark, sf_dir):
    return report.report_lines(collapsed_once(spark, sf_dir), scanned=0).select("group_no", "part", "line")


def report_summary(spark, sf_dir):
    """Links count as scanned, so the number of rows is taken first; it needs no content."""
    return report.report_summary(collapsed(spark, sf_dir), scanned=_table(spark, sf_dir, "documents").count())


def group_members(spark, sf_dir):
    """All paths of each group as one text: for display; the members as rows are report_members."""
    members = groups.in_collisions(collapsed_once(spark, sf_dir), ["size", "digest"])
    return members.groupBy("size", "digest").agg(F.array_join(F.array_sort(F.collect_list("path")), "|").alias("paths"))


def keep_newest(spark, sf_dir):
    return matches.kept(collapsed(spark, sf_dir)).select("size", "keep", "copies")


def extras(spark, sf_dir):
    return matches.extras(collapsed_once(spark, sf_dir))


def same_matches(spark, sf_dir):
    """All paths as one text: for display; the rows are extras."""
    return matches.same_matches(collapsed_once(spark, sf_dir)).select("size", "keep", F.array_join("extras", "|").alias("extras"))


def pair_bytes(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.octet_length("text").cast("long").alias("size"))
    return groups.same_bytes(docs)


def first_two(spark, sf_dir):
    return groups.first_two(collapsed_once(spark, sf_dir), ["size", "digest"])


def same_summary(spark, sf_dir):
    return matches.same_summary(collapsed(spark, sf_dir))


def cross_groups(spark, sf_dir):
    return matches.cross_groups(collapsed(spark, sf_dir))


def cross_summary(spark, sf_dir):
    return matches.cross_summary(collapsed(spark, sf_dir))


def cross_matches(spark, sf_dir):
    m = matches.cross_matches(collapsed_once(spark, sf_dir))
    return m.select("size", F.array_join("a", "|").alias("a"), F.array_join("b", "|").alias("b"))


def side_lists(spark, sf_dir):
    return matches.side_lists(collapsed_once(spark, sf_dir))


def side_totals(spark, sf_dir):
    return matches.side_totals(collapsed_once(spark, sf_dir))


def preview_limit(spark, sf_dir):
    return matches.preview(report.duplicate_groups(collapsed(spark, sf_dir)), ["size", "digest"])


def disposal_plan(spark, sf_dir):
    return disposal.plan_extras(collapsed_once(spark, sf_dir))


def concat_index(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("size"))
    items = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("size"))
    return filters.concatenated([docs, items])


def index_roundtrip(spark, sf_dir):
    lines = files(spark, sf_dir).withColumn("sample", F.lit(None).cast("string")).select(encode_row().alias("line"))
    return lines.select(*decode_row(F.col("line")))


def format_sizes(spark, sf_dir):
    return paths(spark, sf_dir).select("path", format_bytes(F.col("size")).alias("shown"))


def format_ties(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", format_bytes(F.col("l_orderkey") * 256).alias("shown"))


def skip_anti(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    toxic = _table(spark, sf_dir, "labels").filter("toxic = 1")
    return filters.without_paths(docs, toxic, "doc_id")


def suffix_of_url(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", suffix(base_name(F.col("url"))).alias("suffix"))


def parse_extension(spark, sf_dir):
    token = F.explode(F.array(F.col("p_type"), F.concat(F.lit("*."), "p_brand"), F.concat(F.lit(".X"), F.col("p_size").cast("string")))).alias("token")
    return _table(spark, sf_dir, "part").select("p_partkey", token).select("p_partkey", "token", parsed_extension(F.col("token")).alias("ext"))


def under_folder(spark, sf_dir):
    return paths(spark, sf_dir).filter(filters.is_under(F.col("path"), "src1")).select("path")


def drive_paths(spark, sf_dir):
    return paths(spark, sf_dir).select("path", windows_path(F.concat(F.lit("/mnt/c/"), "path")).alias("drive_path"), windows_path(F.col("path")).alias("no_path"))


def no_dups_pages(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select(F.octet_length("html").cast("long").alias("size"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    return groups.colliding(rows, ["size", "digest"])


def _file_name() -> Column:
    return F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit("."), "lang")


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """All documents as files of one folder."""
    return as_folder(_table(spark, sf_dir, "documents"), _file_name())


def _named(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(base_name(F.col("path")).alias("name"), *columns)


def file_scan(spark, sf_dir):
    """A folder's files by listing it: names, sizes and suffixes."""
    return _named(listed(spark, [_folder(spark, sf_dir)], entries=500).filter("error is null"), "size", "ext")


def file_filter(spark, sf_dir):
    """Suffix, size and path filters that the listing takes over."""
    return _named(listed(spark, [_folder(spark, sf_dir)], [".en", ".de"], entries=500).filter("size > 2000"), "size")


def file_groups(spark, sf_dir):
    """The files that have a byte-identical companion: sizes, samples, pairs by bytes, ranges, digests."""
    return _named(compare_files(scan_folders(spark, [_folder(spark, sf_dir)], entries=500)[0]).members, "size", "digest")


def file_pairs(spark, sf_dir):
    """The two files of each size that exactly two have, compared byte by byte up to the first difference."""
    files = scan_folders(spark, [_folder(spark, sf_dir)], entries=500)[0]
    pairs = files.groupBy("size").agg(F.count("*").alias("n"), F.min("path").alias("left"), F.max("path").alias("right")).filter("n = 2")
    none = F.lit(None).cast("array<string>")
    told = compare_pairs_of_files(pairs.select("left", "right", none.alias("left_ranges"), none.alias("right_ranges")))
    return told.select(base_name(F.col("left")).alias("left_name"), base_name(F.col("right")).alias("right_name"), "equal")


def file_index(spark, sf_dir):
    """An index of a folder, written as JSON lines and read again."""
    write_index(scan_folders(spark, [_folder(spark, sf_dir)], entries=500)[0], path := new_folder(spark, "index"))
    return _named(read_index(spark, path), "size", "sample", "digest")


def file_changes(spark, sf_dir):
    """What became of a folder's files since an index that lacks each seventh was kept."""
    files = scan_folders(spark, [_folder(spark, sf_dir)], entries=500)[0]
    write_parquet_index(files.filter(F.substring(base_name(F.col("path")), 1, 9).cast("long") % 7 != 0), path := new_folder(spark, "kept"))
    return _named(changes(files, read_kept(spark, path)), "state")


def file_in_table(spark, sf_dir):
    """The files of a folder whose content a table has: one digest for both. The table is the documents with even ids."""
    files = scan_folders(spark, [_folder(spark, sf_dir)], entries=500)[0]
    digests = written(files.withColumn("digest", file_digest()["digest"]), "digests")
    rows = _table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(content_digest(F.col("text")).alias("digest")).distinct()
    return _named(digests.join(rows, "digest", "left_semi"), "digest")


def object_groups(spark, sf_dir):
    """file_groups by the source for object stores, which has no empty files; the objects lie under prefixes of about 1,000."""
    return _named(equal_objects(spark, as_folders(_table(spark, sf_dir, "documents"), _file_name())), "size", "digest")


def nested_folders(spark, sf_dir):
    """The deepest of many folders, some inside others, that each path lies in."""
    docs = _table(spark, sf_dir, "documents")
    files = docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    named = docs.select(F.col("source").alias("folder")).union(docs.filter("lang = 'en'").select(F.concat_ws("/", "source", "lang"))).distinct()
    return filters.in_folders(files, named.withColumn("depth", F.size(F.split("folder", "/"))))


_FILES = """files AS (
  SELECT doc_id, concat(source, '/', lpad(CAST(doc_id AS VARCHAR), 9, '0'), '.', lang) AS path, source AS folder, '.' || lang AS ext,
    CAST(octet_length(encode(text)) AS BIGINT) AS size, CAST(doc_id % 7 AS DOUBLE) AS mtime, CAST(0 AS BIGINT) AS dev, sha256(text) AS digest, hex(encode(text)) AS bytes,
    CASE WHEN doc_id % 5 = 0 THEN 0 ELSE min(doc_id) OVER (PARTITION BY text, doc_id % 2, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) END AS ino,
    CASE WHEN CAST(substring(source, 4) AS INT) < 10 THEN 'A' ELSE 'B' END AS side
  FROM documents
), sampled AS (
  SELECT *, sha256(unhex(CASE WHEN size > 4096 THEN substring(bytes, 1, 8192) || substring(bytes, 2 * greatest(0, size // 2 - 2048) + 1, 8192) || substring(bytes, 2 * (size - 4096) + 1, 8192) ELSE bytes END)) AS sample FROM files
), one AS (
  SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY size, dev, ino, CASE WHEN ino = 0 THEN path END ORDER BY path) = 1
), dups AS (
  SELECT size, digest, CAST(count(*) AS BIGINT) AS copies, CAST(size * (count(*) - 1) AS BIGINT) AS wasted FROM one GROUP BY size, digest HAVING count(*) >= 2
), numbered AS (SELECT CAST(row_number() OVER (ORDER BY size, digest) AS BIGINT) AS group_no, * FROM dups
), crossed AS (
  SELECT size, digest, CAST(count(*) FILTER (side = 'A') AS BIGINT) AS n_a, CAST(count(*) FILTER (side = 'B') AS BIGINT) AS n_b FROM one GROUP BY size, digest
  HAVING count(*) FILTER (side = 'A') > 0 AND count(*) FILTER (side = 'B') > 0
), newest AS (
  SELECT size, digest, path AS keep, copies FROM one JOIN dups USING (size, digest) QUALIFY row_number() OVER (PARTITION BY size, digest ORDER BY mtime DESC, path) = 1
)"""


def _format(n: str) -> str:
    def unit(power: int, name: str) -> str:
        return f"CAST(CAST(round_even({n} / {1024.0**power}, 1) AS DECIMAL(20, 1)) AS VARCHAR) || ' {name}'"

    return f"CASE WHEN {n} < 1024 THEN CAST({n} AS VARCHAR) || ' B' WHEN {n} < {1024**2} THEN {unit(1, 'KB')} WHEN {n} < {1024**3} THEN {unit(2, 'MB')} WHEN {n} < {1024**4} THEN {unit(3, 'GB')} ELSE {unit(4, 'TB')} END"


def _suffix(name: str) -> str:
    return f"lower(regexp_extract({name}, '(?s)^.+([.][^.]+)$', 1))"


_SQL_NAME, _SQL_SIZE = "(lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.' || lang)", "CAST(octet_length(encode(text)) AS BIGINT)"
_TOKEN = "regexp_replace(regexp_replace(lower(trim(token)), '^[*][.]', '.'), '^[.]', '')"

_SQL: dict[str, tuple[Query, str]] = {
    "scan_ext_filter": (scan_ext_filter, "SELECT path, size, mtime, dev, ino FROM files WHERE ext IN ('.en', '.de')"),
    "size_sort_rank": (size_sort_rank, "SELECT path, size, CAST(row_number() OVER (ORDER BY size, path) AS BIGINT) AS place FROM files"),
    "size_collisions": (size_collisions, "SELECT size, CAST(count(*) AS BIGINT) AS n FROM files GROUP BY size HAVING count(*) >= 2"),
    "size_semi": (size_semi, "SELECT path, size FROM files WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) >= 2)"),
    "collapse_hardlinks": (collapse_hardlinks, "SELECT path, size, mtime, dev, ino FROM one"),
    "full_digest": (full_digest, "SELECT path, size, digest FROM files"),
    "sample_digest": (sample_digest, "SELECT path, size, sample FROM sampled"),
    "sample_groups": (
        sample_groups,
        "SELECT size, sample, CAST(count(*) AS BIGINT) AS n FROM sampled WHERE path IN (SELECT path FROM one) AND size > 12288 GROUP BY size, sample HAVING count(*) >= 2",
    ),
    "digest_groups": (digest_groups, "SELECT size, digest, copies AS n FROM dups"),
    "strategy_tier": (
        strategy_tier,
        """SELECT CASE WHEN size = 0 THEN 'zero' WHEN size > 12288 THEN 'sample' WHEN n = 2 THEN 'pair' ELSE 'hash' END AS tier, CAST(count(*) AS BIGINT) AS buckets, CAST(sum(n) AS BIGINT) AS files
        FROM (SELECT size, count(*) AS n FROM one GROUP BY size HAVING count(*) >= 2) GROUP BY 1""",
    ),
    "pair_compare": (
        pair_compare,
        """SELECT l.size, l.path AS left_path, r.path AS right_path, l.digest = r.digest AS "equal" FROM one l JOIN one r ON l.size = r.size AND l.path < r.path
        WHERE l.size IN (SELECT size FROM one GROUP BY size HAVING count(*) = 2)""",
    ),
    "dup_members": (dup_members, "SELECT path, size, digest FROM one JOIN dups USING (size, digest)"),
    "report_groups": (report_groups, "SELECT group_no, size, copies, wasted FROM numbered"),
    "report_members": (report_members, "SELECT group_no, path FROM one JOIN numbered USING (size, digest)"),
    "report_lines": (
        report_lines,
        """SELECT group_no, CAST(0 AS INT) AS part, '## group ' || group_no || '  size=' || size || '  copies=' || copies || '  wasted=' || wasted AS line FROM numbered
        UNION ALL SELECT group_no, CAST(1 AS INT), path FROM one JOIN numbered USING (size, digest) UNION ALL SELECT group_no, CAST(2 AS INT), '' FROM numbered
        UNION ALL SELECT CAST(4611686018427387904 AS BIGINT), CAST(0 AS INT), '# scanned=0 errors=0 groups=' || count(*) || ' extra_copies=' || coalesce(sum(copies - 1), 0) || ' wasted=' || coalesce(sum(wasted), 0) FROM dups""",
    ),
    "report_summary": (
        report_summary,
        """SELECT (SELECT CAST(count(*) AS BIGINT) FROM files) AS scanned, CAST(0 AS BIGINT) AS errors, CAST(count(*) AS BIGINT) AS groups,
        CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS extra_copies, CAST(coalesce(sum(wasted), 0) AS BIGINT) AS wasted FROM dups""",
    ),
    "group_members": (group_members, "SELECT size, digest, string_agg(path, '|' ORDER BY path) AS paths FROM one JOIN dups USING (size, digest) GROUP BY size, digest"),
    "keep_newest": (keep_newest, "SELECT size, keep, copies FROM newest"),
    "extras": (extras, "SELECT keep, path, size FROM one JOIN newest USING (size, digest) WHERE path <> keep"),
    "same_matches": (same_matches, "SELECT size, keep, string_agg(path, '|' ORDER BY path) AS extras FROM one JOIN newest USING (size, digest) WHERE path <> keep GROUP BY size, keep"),
    "first_two": (
        first_two,
        """SELECT size, digest, min(path) FILTER (k = 1) AS "first", min(path) FILTER (k = 2) AS "second" FROM (SELECT *, row_number() OVER (PARTITION BY size, digest ORDER BY path) AS k FROM one)
        GROUP BY size, digest HAVING count(*) >= 2""",
    ),
    "pair_bytes": (
        pair_bytes,
        """SELECT l.size, l.p AS left_path, r.p AS right_path, l.text = r.text AS "equal" FROM (SELECT *, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS p, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents) l
        JOIN (SELECT *, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS p, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents) r ON l.size = r.size AND l.p < r.p
        WHERE l.size IN (SELECT octet_length(encode(text)) FROM documents GROUP BY 1 HAVING count(*) = 2)""",
    ),
    "same_summary": (
        same_summary,
        """SELECT CAST(count(*) AS BIGINT) AS matches, CAST(coalesce(sum(size), 0) AS BIGINT) AS match_bytes, CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS extras,
        CAST(coalesce(sum(wasted), 0) AS BIGINT) AS extra_bytes FROM dups""",
    ),
    "cross_groups": (cross_groups, "SELECT size, digest, n_a, n_b FROM crossed"),
    "cross_summary": (cross_summary, "SELECT CAST(count(*) AS BIGINT) AS matches, CAST(coalesce(sum(size), 0) AS BIGINT) AS match_bytes FROM crossed"),
    "cross_matches": (
        cross_matches,
        """SELECT size, string_agg(path, '|' ORDER BY path) FILTER (side = 'A') AS a, string_agg(path, '|' ORDER BY path) FILTER (side = 'B') AS b
        FROM one JOIN crossed USING (size, digest) GROUP BY size, digest""",
    ),
    "side_lists": (side_lists, "SELECT side, path, size FROM one JOIN crossed USING (size, digest)"),
    "side_totals": (side_totals, "SELECT side, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS nbytes FROM one JOIN crossed USING (size, digest) GROUP BY side"),
    "preview_limit": (
        preview_limit,
        """SELECT group_no AS place, size, digest, copies, wasted, CAST((SELECT CASE WHEN count(*) > 50 THEN count(*) - 20 ELSE 0 END FROM dups) AS BIGINT) AS more
        FROM numbered WHERE group_no <= (SELECT CASE WHEN count(*) > 50 THEN 20 ELSE count(*) END FROM dups)""",
    ),
    "disposal_plan": (disposal_plan, "SELECT path, 'trash' AS action, 'copy of ' || keep AS reason FROM one JOIN newest USING (size, digest) WHERE path <> keep"),
    "concat_index": (
        concat_index,
        """SELECT 'documents/' || doc_id AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents
        UNION ALL SELECT 'benchmark/' || item_id, CAST(octet_length(encode(text)) AS BIGINT) FROM benchmark""",
    ),
    "index_roundtrip": (index_roundtrip, "SELECT size, mtime, dev, ino, path, CAST(NULL AS VARCHAR) AS sample, digest FROM files"),
    "format_bytes": (format_sizes, f"SELECT path, {_format('size')} AS shown FROM files"),
    "format_ties": (format_ties, f"SELECT l_orderkey, l_linenumber, {_format('(l_orderkey * 256)')} AS shown FROM lineitem"),
    "skip_anti": (skip_anti, "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "suffix_of_url": (suffix_of_url, f"SELECT page_id, {_suffix("list_extract(string_split(url, '/'), -1)")} AS suffix FROM pages"),
    "parse_extension": (
        parse_extension,
        f"""SELECT p_partkey, token, CASE WHEN regexp_full_match({_TOKEN}, '[a-z0-9]{{1,10}}') THEN '.' || {_TOKEN} END AS ext
        FROM (SELECT p_partkey, unnest([p_type, '*.' || p_brand, '.X' || p_size]) AS token FROM part)""",
    ),
    "under_folder": (under_folder, "SELECT path FROM files WHERE starts_with(path, 'src1/')"),
    "drive_paths": (drive_paths, r"SELECT path, 'C:\' || replace(path, '/', '\') AS drive_path, CAST(NULL AS VARCHAR) AS no_path FROM files"),
    "file_scan": (file_scan, f"SELECT {_SQL_NAME} AS name, {_SQL_SIZE} AS size, '.' || lang AS ext FROM documents WHERE text IS NOT NULL"),
    "file_filter": (file_filter, f"SELECT {_SQL_NAME} AS name, {_SQL_SIZE} AS size FROM documents WHERE lang IN ('en', 'de') AND {_SQL_SIZE} > 2000"),
    "file_groups": (file_groups, f"SELECT {_SQL_NAME} AS name, {_SQL_SIZE} AS size, CASE WHEN text = '' THEN '' ELSE sha256(text) END AS digest FROM documents WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY text) >= 2"),
    "file_pairs": (
        file_pairs,
        f"""SELECT min({_SQL_NAME}) AS left_name, max({_SQL_NAME}) AS right_name, min(text) = max(text) AS "equal" FROM documents WHERE text IS NOT NULL GROUP BY {_SQL_SIZE} HAVING count(*) = 2""",
    ),
    "file_index": (file_index, f"SELECT {_SQL_NAME} AS name, {_SQL_SIZE} AS size, CAST(NULL AS VARCHAR) AS sample, CAST(NULL AS VARCHAR) AS digest FROM documents WHERE text IS NOT NULL"),
    "file_changes": (file_changes, f"SELECT {_SQL_NAME} AS name, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE 'same' END AS state FROM documents WHERE text IS NOT NULL"),
    "file_in_table": (file_in_table, f"SELECT {_SQL_NAME} AS name, sha256(text) AS digest FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)"),
    "object_groups": (object_groups, f"SELECT {_SQL_NAME} AS name, {_SQL_SIZE} AS size, sha256(text) AS digest FROM documents WHERE text <> '' QUALIFY count(*) OVER (PARTITION BY text) >= 2"),
    "nested_folders": (
        nested_folders,
        """SELECT source || '/' || lang || '/' || doc_id AS path, source || CASE WHEN lang = 'en' THEN '/en' ELSE '' END AS folder, CAST(CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS INT) AS depth FROM documents""",
    ),
    "no_dups_pages": (no_dups_pages, "SELECT CAST(octet_length(encode(html)) AS BIGINT) AS size, sha256(html) AS digest, CAST(count(*) AS BIGINT) AS n FROM pages GROUP BY 1, 2 HAVING count(*) >= 2"),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _SQL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH {_FILES} {sql}" for name, (_, sql) in _SQL.items()}
