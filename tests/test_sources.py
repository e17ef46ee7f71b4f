"""The listing source, the store source, ordered lines, kept indexes and what a comparison reads."""

import hashlib
import os
import random
import shutil
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from twinsift.functions.content import compare_two, content_digest, file_digest
from twinsift.operators.filters import in_folders
from twinsift.operators.refine import compare_files
from twinsift.plans import cli, disposal
from twinsift.schema import CUTS
from twinsift.sources import flatdir, lines, objects
from twinsift.sources.index import carried_over, changes, read_kept, write_parquet_index

MB = 1 << 20


def write(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, data in files.items():
        (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def names(rows):
    return sorted(os.path.basename(r["path"]) for r in rows.collect())


def grouped(members):
    out = defaultdict(list)
    for r in members.collect():
        out[r["size"], r["digest"]].append(os.path.basename(r["path"]))
    return sorted(sorted(v) for v in out.values())


def test_one_folder_is_many_tasks(spark, tmp_path):
    write(tmp_path, {f"f{k}.txt": "x" * (k % 50) for k in range(3000)})
    whole = flatdir.listed(spark, [str(tmp_path)])
    split = flatdir.listed(spark, [str(tmp_path)], entries=100)
    assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() == 30
    assert flatdir.listed(spark, [str(tmp_path)], entries=100, tasks=7).rdd.getNumPartitions() == 7
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 3000
    shares = split.groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) == 30 and max(r["count"] for r in shares) < 200


def test_filters_go_into_the_listing(spark, tmp_path):
    write(tmp_path, {"a.txt": "x" * 5, "b.TXT": "x" * 50, "c.md": "", "d": "x" * 50, "e.txt": "x" * 60})
    rows = flatdir.listed(spark, [str(tmp_path)], [".txt", ".md"], [str(tmp_path / "e.txt")]).filter("size > 4 and size <= 50").filter("error is null")
    assert names(rows) == ["a.txt", "b.TXT"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "BatchScan flatdir" in plan, plan
    assert names(flatdir.listed(spark, [str(tmp_path)]).filter("path like '%.txt' and size in (5, 60)")) == ["a.txt", "e.txt"]
    assert names(flatdir.listed(spark, [str(tmp_path)]).filter("not (size = 50) and size <> 0")) == ["a.txt", "e.txt"]
    assert names(flatdir.listed(spark, [str(tmp_path)]).filter("size = 0 or ext = ''")) == ["c.md", "d"]  # not for the source
    assert names(flatdir.listed(spark, [str(tmp_path)]).filter("length(ext) = 4")) == ["a.txt", "b.TXT", "e.txt"]


def test_refused_names_are_not_examined(tmp_path, monkeypatch):
    write(tmp_path, {"a.txt": "x", "b.md": "x", "c.md": "x"})
    reader = flatdir.FlatReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([flatdir.ds.EqualTo(("ext",), ".txt"), flatdir.ds.IsNotNull(("size",)), flatdir.ds.EqualTo(("mtime",), 1.0)]))
    assert [f.attribute for f in left] == [("mtime",)]
    seen, real = [], os.scandir

    class Entry:
        def __init__(self, e):
            self.name, self.path, self.e = e.name, e.path, e

        def is_file(self, follow_symlinks):
            return self.e.is_file(follow_symlinks=follow_symlinks)

        def stat(self, follow_symlinks):
            seen.append(self.name)
            return self.e.stat(follow_symlinks=follow_symlinks)

    class Listing:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def __iter__(self):
            return iter([Entry(e) for e in real(tmp_path)])

    monkeypatch.setattr(os, "scandir", lambda _: Listing())
    rows = list(reader.read(flatdir.Share(str(tmp_path), 0, 1)))
    assert seen == ["a.txt"] and [r[4] for r in rows] == [str(tmp_path / "a.txt")]


def test_counts_come_with_the_scan(spark, tmp_path):
    write(tmp_path, {"a": "xx", "b": "yyy"})
    with open(os.path.join(os.fsencode(tmp_path), b"\xff"), "wb"):
        pass
    scan = flatdir.scan_once(spark, [str(tmp_path)])
    assert (scan.scanned, scan.failed, scan.nbytes) == (2, 1, 5) and names(scan.files) == ["a", "b"]
    assert scan.errors.first()["error"] == "the name is not UTF-8"
    empty = flatdir.scan_once(spark, [str(tmp_path / "none")])
    assert (empty.scanned, empty.failed, empty.nbytes) == (0, 0, 0)


def test_two_large_files_are_read_up_to_their_difference(spark, tmp_path):
    a = random.Random(1).randbytes(40 * MB)
    b = bytearray(a)
    b[300_000] ^= 1  # not in a sampled window
    write(tmp_path, {"a": a, "b": bytes(b)})
    told = compare_files(flatdir.scan_folders(spark, [str(tmp_path)])[0])
    assert told.members.count() == 0 and told.reads.agg(F.sum("bytes")).first()[0] <= 4 * MB
    write(tmp_path, {"c": a})  # three: range by range, and the two equal ones whole
    told = compare_files(flatdir.scan_folders(spark, [str(tmp_path)])[0])
    assert grouped(told.members) == [["a", "c"]]
    by = {os.path.basename(r["path"]): r["n"] for r in told.reads.groupBy("path").agg(F.sum("bytes").alias("n")).collect()}
    assert by["b"] <= 2 * MB and by["a"] == by["c"] <= 40 * MB + CUTS[-1]
    assert told.members.first()["digest"] == hashlib.sha256(a).hexdigest()


@pytest.mark.parametrize("size", [0, 1, CUTS[0] - 1, CUTS[0], CUTS[0] + 1, CUTS[1], CUTS[1] + 5])
def test_two_files(tmp_path, size):
    data = random.Random(size).randbytes(size)
    write(tmp_path, {"a": data, "b": data})
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    equal, digest, *errors, n, ra, rb = compare_two(a, b, ([], []), "sha256")
    assert equal and digest == hashlib.sha256(data).hexdigest() and errors == [None, None] and n == 2 * size and ra == rb
    ends = [e for e in (0, *CUTS) if e < size]
    assert ra == [hashlib.sha256(data[s : e if e <= size else size]).hexdigest() for s, e in zip(ends, [*ends[1:], *[c for c in CUTS if c >= size][:1]], strict=False)]
    for at in {0, size // 2, size - 1} if size else ():
        (tmp_path / "b").write_bytes(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        equal, digest, *_, ra, rb = compare_two(a, b, ([], []), "sha256")
        assert equal is False and digest is None and ra != rb
        assert compare_two("/none", "/none", (ra, rb), "sha256")[:2] == (False, None)  # known, so not read
    assert compare_two(a, "/none", ([], []), "sha256")[0] is None and "No such file" in compare_two(a, "/none", ([], []), "sha256")[3]


def test_a_second_run_reads_what_changed(spark, tmp_path):
    r = random.Random(2)
    big = r.randbytes(200_000)
    files = {"p1": "same", "p2": "same", "q1": "ab", "q2": "cd", "t1": "xyz", "t2": "xyz", "t3": "zzz", "l1": big, "l2": big, "l3": big[:100_000] + b"!" + big[100_001:], "m1": b"m" * 20_000, "m2": b"m" * 6000 + b"n" + b"m" * 13_999, "z1": "", "z2": ""}
    write(tmp_path / "in", files)
    kept = str(tmp_path / "kept")
    scan = lambda: flatdir.scan_folders(spark, [str(tmp_path / "in")])[0]
    first = compare_files(scan())
    want = [["l1", "l2"], ["p1", "p2"], ["t1", "t2"], ["z1", "z2"]]
    assert grouped(first.members) == want
    write_parquet_index(first.index, kept)
    second = compare_files(carried_over(scan(), read_kept(spark, kept)))
    assert grouped(second.members) == want and (second.reads.agg(F.sum("bytes")).first()[0] or 0) == 0
    write(tmp_path / "in", {"t3": "xyz", "new": "ab"})
    (tmp_path / "in" / "p2").unlink()
    state = {os.path.basename(x["path"]): x["state"] for x in changes(scan(), read_kept(spark, kept)).collect()}
    assert {k: v for k, v in state.items() if v != "same"} == {"t3": "changed", "new": "new", "p2": "gone"}
    third = compare_files(carried_over(scan(), read_kept(spark, kept)))
    assert grouped(third.members) == [["l1", "l2"], ["new", "q1"], ["t1", "t2", "t3"], ["z1", "z2"]]
    assert sorted({os.path.basename(x["path"]) for x in third.reads.filter("bytes > 0").collect()}) == ["new", "t3"]


def test_read_errors_are_rows(spark, tmp_path):
    write(tmp_path, {"a": "pair", "b": "pair", "c": "three", "d": "three", "e": "three"})
    files = flatdir.scan_folders(spark, [str(tmp_path)])[0]
    files = spark.createDataFrame(files.collect(), files.schema)
    for n in "ae":
        (tmp_path / n).unlink()
    told = compare_files(files)
    assert grouped(told.members) == [["c", "d"]] and names(told.errors) == ["a", "e"] and all("No such file" in x["error"] for x in told.errors.collect())
    twice = told.reads.groupBy("path").count().filter("count > 1")
    assert twice.count() == 0


def test_one_digest_for_tables_and_files(spark, tmp_path):
    texts = {"a.txt": "ein Text", "b.txt": "другой", "c.txt": "no match"}
    write(tmp_path, texts)
    table = spark.createDataFrame([(1, "ein Text"), (2, "другой"), (3, None)], "id long, text string")
    for algorithm in ("sha256", "blake2b", "md5"):
        rows = table.withColumn("digest", content_digest(F.col("text"), algorithm))
        files = flatdir.scan_folders(spark, [str(tmp_path)])[0].withColumn("digest", file_digest(algorithm=algorithm)["digest"])
        got = {os.path.basename(r["path"]): r["id"] for r in files.join(rows, "digest").collect()}
        assert got == {"a.txt": 1, "b.txt": 2} and rows.filter("id = 1").first()["digest"] == hashlib.new(algorithm, b"ein Text").hexdigest()
    with pytest.raises(ValueError, match="unsupported hash"):
        content_digest(F.col("text"), "no such")


def test_store_source_and_its_six_differences(spark, tmp_path):
    write(tmp_path, {"a.txt": "same", "b.txt": "same", "B.TXT": "same", "c.txt": "diff", "empty1": "", "empty2": "", ".dot": "same", "_under": "same", "long1": "x" * 900, "long2": "x" * 900, "solo": "y" * 901})
    os.link(tmp_path / "long1", tmp_path / "hard")
    os.symlink(tmp_path / "a.txt", tmp_path / "sym.txt")
    (tmp_path / "nested").mkdir()
    write(tmp_path / "nested", {"n.txt": "same"})
    flat = grouped(compare_files(flatdir.scan_folders(spark, [str(tmp_path)])[0]).members)
    assert flat == [[".dot", "B.TXT", "_under", "a.txt", "b.txt"], ["empty1", "empty2"], ["hard", "long2"]]
    store = objects.equal_objects(spark, str(tmp_path))
    # 1 no empty files, 2 no names with . or _, 3 links are followed, 4 no inodes, so hard links count as copies
    assert grouped(store) == [["B.TXT", "a.txt", "b.txt", "sym.txt"], ["hard", "long1", "long2"]]
    listed = objects.list_objects(spark, str(tmp_path))
    assert all(r["mtime"] * 1000 == int(r["mtime"] * 1000) and r["ino"] == 0 for r in listed.collect())  # 4 whole milliseconds
    globbed = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(str(tmp_path)).select("path")
    assert "B.TXT" not in names(globbed) and "B.TXT" in names(objects.list_objects(spark, str(tmp_path), [".txt"]))  # 5 ours folds case
    assert all(r["path"].startswith("file:/") for r in listed.collect())  # 6 URIs
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    ranges = objects.size_ranges(listed)
    plan = objects.object_digests(spark, str(tmp_path), ranges)._jdf.queryExecution().executedPlan().toString()
    assert ranges == [(4, 4), (900, 900)] and "GreaterThanOrEqual(length,4)" in plan
    assert objects.equal_objects(spark, str(tmp_path / "nested")).count() == 0


def test_lines_are_whole_and_in_order(spark, tmp_path):
    folder = tmp_path / "out"
    rows = spark.range(1000).repartition(7).select(F.col("id").alias("k"), F.format_string("line %d", "id").alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines.write_lines(rows, str(folder), "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert list(lines.read_lines(folder)) == [f"line {k}" for k in range(1000)] and len(lines.read_manifest(folder)) > 1
    assert sorted(os.listdir(folder)) == sorted([*(p["file"] for p in lines.read_manifest(folder)), lines.MANIFEST])
    forged = spark.createDataFrame([(1, "a\n## group 9\r\u2028"), (2, "b")], "k long, line string")
    lines.write_lines(forged, str(folder), "k")
    assert list(lines.read_lines(folder)) == ["a\\u000a## group 9\\u000d\\u2028", "b"] and len(os.listdir(folder)) == 1 + len(lines.read_manifest(folder))

    @F.udf("string")
    def fails(k):
        if k == 700:
            raise RuntimeError("lost")
        return "new"

    with pytest.raises(Exception, match="lost"):
        lines.write_lines(spark.range(1000).select(F.col("id").alias("k"), fails("id").alias("line")), str(folder), "k")
    assert list(lines.read_lines(folder))[1] == "b" and not [n for n in os.listdir(folder) if n.startswith(".")]
    lines.write_lines(forged.limit(0), str(folder), "k")
    assert list(lines.read_lines(folder)) == []


def test_the_deepest_folder(spark):
    paths = ["src1/a", "src10/a", "src1/sub/b", "src1/sub/deep/c", "src1/subway/d", "other/e", "f", "/abs/x/y"]
    files = spark.createDataFrame([(p, len(p)) for p in paths], "path string, size int")
    folders = spark.createDataFrame([("src1/", "A"), ("src1/sub", "B"), ("src1/sub/deep", "C"), ("/abs", "D"), ("src1/sub", "again")], "folder string, side string")
    got = {r["path"]: r["side"] for r in in_folders(files, folders.filter("side <> 'again'")).collect()}
    assert got == {"src1/a": "A", "src10/a": None, "src1/sub/b": "B", "src1/sub/deep/c": "C", "src1/subway/d": "A", "other/e": None, "f": None, "/abs/x/y": "D"}
    assert in_folders(files, folders).count() == len(paths)


def test_disposal_acts_once(spark, tmp_path):
    write(tmp_path / "in", {f"f{k}": "x" for k in range(20)})
    plan = spark.createDataFrame([(str(tmp_path / "in" / f"f{k}"),) for k in range(20)] + [(str(tmp_path / "none"),), (str(tmp_path / "in" / "f3"),)], "path string")
    bin_, journal = str(tmp_path / "bin"), str(tmp_path / "journal")
    dispose = disposal.into_folder(bin_)
    dry = disposal.carry_out(plan, dispose, journal)
    assert {r["outcome"] for r in dry.collect()} == {"listed"} and not os.path.exists(bin_)
    out = disposal.carry_out(plan, dispose, journal, dry_run=False)
    assert {r["outcome"]: r["count"] for r in out.groupBy("outcome").count().collect()} == {"done": 20, "failed": 1}
    assert "none" in out.filter("outcome = 'failed'").first()["error"] and len(os.listdir(bin_)) == 20
    write(tmp_path / "in", {"f1": "a new file of that name"})  # a task that runs again finds the journal and leaves it alone
    again = disposal.carry_out(plan, dispose, journal, dry_run=False)
    assert {r["outcome"]: r["count"] for r in again.groupBy("outcome").count().collect()} == {"done": 20, "failed": 1} and (tmp_path / "in" / "f1").exists()
    begun = tmp_path / "begun"
    begun.mkdir()
    for name in ("f1", "f2"):  # entries that a lost task made: one file is still there, the other has gone
        (begun / hashlib.sha256(str(tmp_path / "in" / name).encode()).hexdigest()).touch()
    rows = {os.path.basename(r["path"]): r["outcome"] for r in disposal.carry_out(plan.filter("path like '%f1' or path like '%f2'"), dispose, str(begun), dry_run=False).collect()}
    assert rows == {"f1": "unsettled", "f2": "done"} and (tmp_path / "in" / "f1").exists()


def test_command_line_moves_and_keeps(spark, tmp_path, capfd):
    write(tmp_path / "A", {"x": "same", "y": "other"})
    write(tmp_path / "B", {"z": "same", "w": "own"})
    a, b, bin_, kept = (str(tmp_path / n) for n in ("A", "B", "bin", "kept"))
    assert cli.main([a, b]) == 0 and os.path.exists(f"{b}/z")
    assert cli.main([a, b, "--move-to", a]) == 2
    assert cli.main([a, b, "--move-to", bin_]) == 0 and not os.path.exists(f"{b}/z") and os.path.exists(f"{a}/x") and len(os.listdir(bin_)) == 1
    write(tmp_path / "B", {"z": "same"})
    assert cli.main([a, b, "--move-to", bin_]) == 1 and os.path.exists(f"{b}/z") and "failed: 1" in capfd.readouterr().out  # its name is taken
    for _ in range(2):
        assert cli.main([a, "--report", str(tmp_path / "report"), "--kept", kept]) == 0
        assert list(lines.read_lines(tmp_path / "report")) == ["# scanned=2 errors=0 groups=0 extra_copies=0 wasted=0"] and read_kept(spark, kept).count() == 2
    shutil.rmtree(kept)


def _tasks(spark, group):
    """The most tasks of a stage of the job group."""
    tracker = spark.sparkContext.statusTracker()
    return max(tracker.getStageInfo(k).numTasks for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds)


def test_folder_of_a_table_in_one_piece(spark):
    from twinsift.sources.tables import as_folder

    docs = spark.range(600).coalesce(1).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    spark.sparkContext.setJobGroup("folder", "")
    try:
        folder = as_folder(docs, F.col("doc_id").cast("string"), entries=50)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(os.listdir(folder)) == sorted(map(str, range(600))) and _tasks(spark, "folder") == 12


def test_objects_many_to_a_task(spark, tmp_path):
    from twinsift.sources.objects import equal_objects

    for k in range(400):
        (tmp_path / f"f{k}").write_text(str(k % 300).zfill(4))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.sparkContext.setJobGroup("objects", "")
    try:
        found = equal_objects(spark, str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.count() == 200 and _tasks(spark, "objects") <= 8 and spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_objects_of_many_folders_are_listed_in_turn(spark, tmp_path, monkeypatch):
    """The driver holds the names of a few folders' objects at a time; copies in different turns are found all the same."""
    from twinsift.sources.tables import as_folders

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") != 7, (F.col("id") % 200 + 1000).cast("string")).alias("text"))
    folders = as_folders(docs, F.col("doc_id").cast("string"), held=20)
    assert len(folders) == 15 and sorted(n for f in folders for n in os.listdir(f)) == sorted(str(k) for k in range(300) if k != 7)
    held = []
    for name in ("list_objects", "object_digests"):
        monkeypatch.setattr(objects, name, lambda *a, f=getattr(objects, name), **k: (out := f(*a, **k), held.append(len(out.inputFiles())))[0])
    found = objects.equal_objects(spark, folders, at_once=4)
    assert names(found) == sorted(str(k) for k in range(300) if k % 200 < 100 and k % 200 != 7)
    assert len(held) == 8 and max(held) <= 150 and sum(held) == 2 * 299
