"""Folders scanned and compared from end to end."""

import json
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from twinsift.operators.groups import collapse_links
from twinsift.operators.refine import confirm_duplicates, unreadable
from twinsift.plans import cli, disposal, matches, report
from twinsift.schema import FILES
from twinsift.sources.flatdir import scan_folders
from twinsift.sources.index import read_index, read_parquet_index, write_index, write_parquet_index
from twinsift.sources.lines import read_lines


def write(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, data in files.items():
        (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def found(spark, folder, ext=None, before=None):
    files, _ = scan_folders(spark, [str(folder)], ext)
    if before:
        files = spark.createDataFrame(files.collect(), files.schema)  # listed now, read later
        before()
    rows = confirm_duplicates(files).select("size", "digest", "path").collect()
    out = defaultdict(list)
    for r in rows:
        out[r["size"], r["digest"]].append(os.path.basename(r["path"]))
    return sorted(sorted(v) for v in out.values())


def test_equal_content(spark, tmp_path):
    write(tmp_path, {"a.txt": "same", "b.txt": "same", "c.txt": "different"})
    assert found(spark, tmp_path) == [["a.txt", "b.txt"]]


def test_equal_size_is_not_enough(spark, tmp_path):
    write(tmp_path, {"a.bin": "abc", "b.bin": "abd"})
    assert found(spark, tmp_path) == []


def test_empty_files(spark, tmp_path):
    write(tmp_path, {"empty-a": "", "empty-b": ""})
    assert found(spark, tmp_path) == [["empty-a", "empty-b"]]


def test_links_are_one_file(spark, tmp_path):
    write(tmp_path, {"x": "same inode"})
    os.link(tmp_path / "x", tmp_path / "y")
    assert found(spark, tmp_path) == []
    write(tmp_path, {"z": "same inode"})
    assert found(spark, tmp_path) == [["x", "z"]]


def test_flat_and_by_extension(spark, tmp_path):
    write(tmp_path, {"a.txt": "same", "b.TXT": "same", "a.bin": "same", ".c.txt": "same", "_d.txt": "same"})
    write(tmp_path / "nested", {"nested.txt": "same"})
    os.symlink(tmp_path / "a.txt", tmp_path / "link.txt")
    assert found(spark, tmp_path, [".txt"]) == [[".c.txt", "_d.txt", "a.txt", "b.TXT"]]


def test_large_files(spark, tmp_path):
    big = random.Random(1).randbytes(20_000)
    other = big[:6000] + bytes([big[6000] ^ 1]) + big[6001:]  # differs outside the sampled windows
    write(tmp_path, {"p": big, "q": other})
    assert found(spark, tmp_path) == []
    write(tmp_path, {"r": big, "s": big})
    assert found(spark, tmp_path) == [["p", "r", "s"]]


@pytest.mark.parametrize("size", [12_288, 12_289])
def test_both_sides_of_the_sampling_bound(spark, tmp_path, size):
    write(tmp_path, {"a": b"x" * size, "b": b"x" * size})
    assert found(spark, tmp_path) == [["a", "b"]]


def test_three_small_and_two_groups_of_one_size(spark, tmp_path):
    write(tmp_path, {"a": "0123456789", "b": "0123456789", "c": "0123456789", "d": "9876543210"})
    assert found(spark, tmp_path) == [["a", "b", "c"]]
    write(tmp_path, {"e": "9876543210"})
    assert found(spark, tmp_path) == [["a", "b", "c"], ["d", "e"]]


def test_files_that_go_missing(spark, tmp_path):
    write(tmp_path, {"a": "pair", "b": "pair", "c": "three", "d": "three", "e": "three", "f": "", "g": ""})

    def gone():
        for name in "aefg":
            (tmp_path / name).unlink()

    assert found(spark, tmp_path, before=gone) == [["c", "d"], ["f", "g"]]  # empty files are never read
    (lost,) = unreadable(spark.createDataFrame([(3, "/no/such/file"), (0, "/none")], "size long, path string")).collect()
    assert lost["path"] == "/no/such/file" and "No such file" in lost["error"]


def test_unlisted_folder_and_skipped_paths(spark, tmp_path):
    files, errors = scan_folders(spark, [str(tmp_path / "none")])
    assert files.count() == errors.count() == 0
    write(tmp_path, {"a": "x", "b": "x"})
    files, _ = scan_folders(spark, [str(tmp_path)], skip=[str(tmp_path / "b")])
    assert [os.path.basename(r["path"]) for r in files.collect()] == ["a"]


def test_unknown_inodes_stay_apart(spark):
    rows = [(1, 0.0, 0, 0, "a"), (1, 0.0, 0, 0, "b"), (1, 0.0, 0, 7, "c"), (1, 0.0, 0, 7, "d")]
    df = spark.createDataFrame(rows, "size long, mtime double, dev long, ino long, path string")
    assert sorted(r["path"] for r in collapse_links(df).collect()) == ["a", "b", "c"]


def test_any_folder(spark, tmp_path):
    rng = random.Random(5)
    for k in range(6):
        folder, groups = tmp_path / str(k), defaultdict(list)
        files = {f"f{i}": rng.choice([b"", b"a", b"b", b"ab", b"ba", b"x" * 13_000, b"x" * 12_999 + b"y"]) for i in range(rng.randrange(14))}
        write(folder, files)
        for name, data in files.items():
            groups[data].append(name)
        assert found(spark, folder) == sorted(sorted(v) for v in groups.values() if len(v) > 1)


def test_report(spark, tmp_path, capsys):
    write(tmp_path / "in", {"a.txt": "same", "b.txt": "same", "c.txt": "other"})
    summary = cli.folder_report(spark, str(tmp_path / "in"), str(tmp_path / "out"), index=str(tmp_path / "index")).first()
    assert tuple(summary) == (3, 0, 1, 1, 4)
    lines = list(read_lines(tmp_path / "out"))
    a, b = (str((tmp_path / "in" / n).resolve()) for n in ("a.txt", "b.txt"))
    assert lines == ["## group 1  size=4  copies=2  wasted=4", a, b, "", "# scanned=3 errors=0 groups=1 extra_copies=1 wasted=4"]
    assert sorted(os.path.basename(r["path"]) for r in read_index(spark, str(tmp_path / "index")).collect()) == ["a.txt", "b.txt", "c.txt"]


def test_nothing_to_report(spark, tmp_path):
    write(tmp_path / "in", {"a": "x"})
    assert tuple(cli.folder_report(spark, str(tmp_path / "in"), str(tmp_path / "out")).first()) == (1, 0, 0, 0, 0)


def test_two_folders(spark, tmp_path):
    write(tmp_path / "A", {"x": "same", "y": "same", "p": "only a", "q": "only a"})
    write(tmp_path / "B", {"z": "same", "w": "other"})
    files = cli.compare(spark, str(tmp_path / "A"), str(tmp_path / "B"))
    (match,) = matches.cross_matches(files).collect()
    assert match["size"] == 4 and [[os.path.basename(p) for p in match[s]] for s in "ab"] == [["x", "y"], ["z"]]
    assert tuple(matches.cross_summary(files).first()) == (1, 4)
    assert sorted(tuple(r) for r in matches.side_totals(files).collect()) == [("A", 2, 8), ("B", 1, 4)]
    with pytest.raises(disposal.UnsafePlan):
        cli.compare(spark, str(tmp_path), str(tmp_path / "A"))


def test_keep_newest(spark, tmp_path):
    rows = [(4, 10.0, "b", "d"), (4, 20.0, "b2", "d"), (4, 20.0, "a2", "d"), (4, 30.0, "z", "other")]
    df = spark.createDataFrame(rows, "size long, mtime double, path string, digest string")
    assert [r["keep"] for r in matches.kept(df).collect()] == ["a2"]
    assert sorted(r["path"] for r in matches.extras(df).collect()) == ["b", "b2"]
    assert tuple(matches.same_summary(df).first()) == (1, 4, 2, 8)
    (m,) = matches.same_matches(df).collect()
    assert (m["keep"], m["extras"]) == ("a2", ["b", "b2"])
    plan = disposal.plan_extras(df)
    assert plan.count() < df.filter("digest = 'd'").count()


def test_disposal_lists_first(spark, tmp_path):
    write(tmp_path, {"a": "x"})
    plan = spark.createDataFrame([(str(tmp_path / "a"),), (str(tmp_path / "none"),)], "path string")
    assert disposal.apply(plan, os.unlink) == (1, 1) and (tmp_path / "a").exists()
    assert disposal.apply(plan, os.unlink, dry_run=False) == (1, 1) and not (tmp_path / "a").exists()


@pytest.mark.parametrize(("groups", "shown", "more"), [(50, 50, 0), (51, 20, 31)])
def test_preview(spark, groups, shown, more):
    df = spark.range(groups).select(F.col("id").alias("size"), F.col("id").cast("string").alias("digest"))
    rows = matches.preview(df, ["size", "digest"]).collect()
    assert sorted(r["place"] for r in rows) == list(range(1, shown + 1)) and {r["more"] for r in rows} == {more}


def test_index_lines(spark, tmp_path):
    rows = [(2**53 + 1, 1795695402.3266366, 1, 2**62, 'q"\\é\n,', None, "d"), (0, 1e-7, 0, 0, "", "s", None)]
    df = spark.createDataFrame(rows, "size long, mtime double, dev long, ino long, path string, sample string, digest string")
    write_index(df, str(tmp_path / "i"))
    assert sorted(map(tuple, read_index(spark, str(tmp_path / "i")).collect())) == sorted(rows)


def test_command_line_names_the_files(spark, tmp_path, capfd):
    write(tmp_path / "A", {"x": "same", "y": "same", "p": "only a"})
    write(tmp_path / "B", {'z"é': "same", "w": "other"})
    a, b = (str((tmp_path / s).resolve()) for s in "AB")
    assert cli.main([a, b, "--lists", str(tmp_path / "lists"), "--plan", str(tmp_path / "plan"), "--side", "B"]) == 0
    out = capfd.readouterr().out
    assert all(f"{a}/{n}" in out for n in "xy") and f"{a}/p" not in out
    lines = {s: sorted(json.loads(line) for f in (tmp_path / "lists" / f"side={s}").glob("part-*") for line in f.read_text(encoding="utf-8").splitlines()) for s in "AB"}
    assert lines == {"A": [f"{a}/x", f"{a}/y"], "B": [f'{b}/z"é']}
    assert [r["path"] for r in spark.read.json(str(tmp_path / "plan")).collect()] == [f'{b}/z"é']
    assert cli.main([a, a, "--plan", str(tmp_path / "plan")]) == 0
    (gone,) = [r["path"] for r in spark.read.json(str(tmp_path / "plan")).collect()]
    assert gone in (f"{a}/x", f"{a}/y") and gone in capfd.readouterr().out


def test_parquet_index(spark, tmp_path):
    write(tmp_path / "in", {"a": "x", "b": "yy"})
    files, _ = scan_folders(spark, [str(tmp_path / "in")])
    write_parquet_index(files, str(tmp_path / "index"))
    got = read_parquet_index(spark, str(tmp_path / "index"))
    assert got.columns == FILES.names and sorted((r["size"], os.path.basename(r["path"])) for r in got.collect()) == [(1, "a"), (2, "b")]


def test_exit_codes(tmp_path, capsys):
    assert cli.main([str(tmp_path / "none")]) == 2
    assert cli.main([str(tmp_path), "--ext", "a,b"]) == 2
    (tmp_path / "in").mkdir()
    assert cli.main([str(tmp_path), str(tmp_path / "in")]) == 2


def test_summary_of_no_rows(spark):
    empty = spark.createDataFrame([], "size long, digest string, path string, mtime double, side string")
    assert tuple(report.report_summary(empty).first()) == (0, 0, 0, 0, 0)
    assert tuple(matches.cross_summary(empty).first()) == (0, 0)
    assert report.report_groups(empty).count() == 0
