"""File fixtures: features, sequences and hits, static and streamed."""

from __future__ import annotations

import bz2
import gzip

import pytest
from pyspark.sql import functions as F

from loci import sources as src
from loci import streaming
from loci.operators import hierarchy as hi

ROWS = """##gff-version 3
##sequence-region chrA 1 60000
chrA x repeat_region 1001 9000 . + . ID=repeat_region1
chrA x target_site_duplication 1001 1005 . + . Parent=repeat_region1
chrA x LTR_retrotransposon 1006 8995 . + . ID=LTR_retrotransposon1;Parent=repeat_region1;ltr_similarity=97.5
chrA x long_terminal_repeat 1006 1505 . + . Parent=LTR_retrotransposon1
chrA x primer_binding_site 1508 1520 . + . Parent=LTR_retrotransposon1;trna=a%3Bb,c+d,50%
chrA x protein_match 3000 3600 . + . Parent=LTR_retrotransposon1;name=RVT_1
chrA x protein_match 3500 3900 . + . Parent=LTR_retrotransposon1;name=RVT_1
chrA x RR_tract 8400 8420 . + . Parent=LTR_retrotransposon1
chrA x long_terminal_repeat 8496 8995 . + . Parent=LTR_retrotransposon1
chrA x target_site_duplication 8996 9000 . + . Parent=repeat_region1
chrA x repeat_region 20001 20700 . ? . ID=repeat_region2
chrA x terminal_inverted_repeat_element 20003 20502 . ? . ID=terminal_inverted_repeat_element1;Parent=repeat_region2
chrA x protein_match 30000 30100 . + . Parent=LTR_retrotransposon1;name=outside
"""


def feature_file(tmp_path):
    path = tmp_path / "f1.gff3"
    body = "\n".join(x if x.startswith("#") else x.replace(" ", "\t") for x in ROWS.splitlines()) + "\n###\nbroken line\n"
    path.write_text(body)
    return str(path)


def test_feature_file(spark, tmp_path):
    t = src.read_features(spark, feature_file(tmp_path))
    assert [r["_corrupt"] for r in t.where("_corrupt IS NOT NULL").collect()] == ["broken line"]
    trna = t.where("type = 'primer_binding_site'").first()["attributes"]["trna"]
    assert trna == ["a;b", "c+d", "50%"]
    region = src.read_sequence_regions(spark, feature_file(tmp_path)).first()
    assert (region["seq_id"], region["start"], region["end"]) == ("chrA", 1, 60000)
    regions, elements, parts = src.region_tree(t.where("_corrupt IS NULL"))
    assert regions.count() == 2 and elements.count() == 2
    assert parts.where("name = 'outside'").count() == 0
    score = hi.score_elements(parts).where("element_id = 'LTR_retrotransposon1'").first()
    assert (score["pbs"], score["ppt"], score["domains"], score["ir"], score["tsd_equal"], score["score"]) == (1, 1, 2, 0, 1, 5)
    assert hi.architecture_detail(parts).first()["architecture"] == "RVT_1{3000-3900}"
    assert hi.domain_flags(parts).first()["superfamily"] == "Gypsy"
    mite = hi.relabel(elements, parts, "terminal_inverted_repeat_element", "MITE", 600)
    assert {r["element_id"]: r["new_type"] for r in mite.collect()}["terminal_inverted_repeat_element1"] == "MITE"


def test_feature_file_is_ordered(spark, tmp_path):
    t = src.read_features(spark, feature_file(tmp_path)).where("_corrupt IS NULL").drop("_corrupt")
    out = str(tmp_path / "out")
    src.write_features(t, spark.createDataFrame([("chrA", 60000)], "seq_id string, length bigint"), out)
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[:2] == ["##gff-version 3", "##sequence-region chrA 1 60000"]
    starts = [int(x.split("\t")[3]) for x in lines[2:]]
    assert starts == sorted(starts)
    assert lines[2].split("\t")[2] == "repeat_region"
    assert any("trna=a%3Bb,c+d,50%25" in x for x in lines)


FASTA = ">s1 first one\nACGTacgt\nNNN\n>s2\tx y\r\nAC GT\r\n>\n>s3\n" + "A" * 130 + "\n>s4\n"


def test_sequence_files(spark, tmp_path):
    want = {"s1": ("first one", "ACGTacgtNNN"), "s2": ("x y", "ACGT"), "s3": ("", "A" * 130), "s4": ("", "")}
    (tmp_path / "a.fa").write_bytes(FASTA.encode())
    with gzip.open(tmp_path / "b.fa.gz", "wb") as f:
        f.write(FASTA.encode())
    with bz2.open(tmp_path / "c.fa.bz2", "wb") as f:
        f.write(FASTA.encode())
    for name in ("a.fa", "b.fa.gz", "c.fa.bz2"):
        got = {r["seq_id"]: (r["description"], r["residues"]) for r in src.read_sequences(spark, str(tmp_path / name)).collect()}
        assert got == want
    src.write_sequences(src.read_sequences(spark, str(tmp_path / "a.fa")), str(tmp_path / "out"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    assert "\n" + "A" * 60 + "\n" + "A" * 60 + "\n" + "A" * 10 + "\n" in text


def test_chunks_do_not_depend_on_file_splits(spark, tmp_path):
    from loci.operators.sequences import windows

    letters = "ACGTTGCATTAGC"
    records = {f"r{i}": (letters * 200)[i : i + 150 * (i + 1)] for i in range(8)}
    body = "".join(f">{k} d\n" + "\n".join(s[i : i + 30] for i in range(0, len(s), 30)) + "\n" for k, s in records.items())
    (tmp_path / "x.fa").write_text(body)
    want = windows(spark.createDataFrame(list(records.items()), "seq_id string, residues string"), 100, 20)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
        got = src.read_sequence_chunks(spark, str(tmp_path / "x.fa"), 100, 20).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("range_bytes", [23, 1000, 1 << 20])
def test_chunks_from_byte_ranges(spark, tmp_path, range_bytes):
    """Ranges may begin anywhere: in headers, at line ends, inside records of one line."""
    from loci.operators.sequences import windows

    letters = "ACGTTGCATTAGC"
    records = {f"r{i}": (letters * 200)[i : i + 97 * i] for i in range(1, 9)}
    body = "".join(f">{k} a description of some length\n{s}\n" if i % 2 else f">{k}\r\n" + "\r\n".join(s[j : j + 30] for j in range(0, len(s), 30)) + "\r\n\r\n" for i, (k, s) in enumerate(records.items()))
    (tmp_path / "x.fa").write_bytes(body.encode()[:-1])  # the last line is open
    with gzip.open(tmp_path / "y.fa.gz", "wb") as f:
        f.write(body.replace(">r", ">z").encode())
    both = records | {k.replace("r", "z"): s for k, s in records.items()}
    want = windows(spark.createDataFrame(list(both.items()), "seq_id string, residues string"), 100, 20)
    got = src.read_sequence_chunks(spark, str(tmp_path / "*"), 100, 20, range_bytes=range_bytes).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("kind", ["plain", "gz"])
def test_a_long_record_of_one_line_is_never_in_one_row(spark, tmp_path, kind):
    from loci.sources.ranges import read_range_lines

    n, path = 250_000_000 if kind == "plain" else 50_000_000, str(tmp_path / ("long.fa" if kind == "plain" else "long.fa.gz"))
    opened = open(path, "wb") if kind == "plain" else gzip.open(path, "wb", compresslevel=1)
    with opened as f:
        f.write(b">one\n")
        for _ in range(n // 1_000_000):
            f.write(b"ACGTTGCATA" * 100_000)
        f.write(b"\n>two\nACGT\n")
    rows = read_range_lines(spark, path, 8 << 20)
    longest, total, tasks = rows.select(F.max(F.length("line")), F.sum(F.length("line")), F.count_distinct("_tile")).first()
    assert longest <= 1 << 16 and total == n + 4 + len(">one>two") and tasks > n // (9 << 20)
    if kind == "plain":
        assert rows.rdd.getNumPartitions() > 25
    chunks = src.read_sequence_chunks(spark, path, range_bytes=8 << 20)
    sizes = chunks.groupBy("seq_id").agg(F.max("core_end"), F.max(F.length("residues")), F.sum(F.length("residues") - F.col("left_pad") - F.col("right_pad"))).collect()
    assert sorted(map(tuple, sizes)) == [("one", n, 50_200, n), ("two", 4, 4, 4)]


HITS = "q\ts\t90.0\t100\t1\t0\t1\t100\t200\t101\t1e-9\t55.5\n# comment\nq\ts\t90.0\t100\t1\t0\t1\t100\t5\t104\t1e-9\n"


def test_hit_file(spark, tmp_path):
    (tmp_path / "h.tsv").write_text(HITS)
    rows = src.read_hits(spark, str(tmp_path / "h.tsv")).collect()
    assert [(r["s_start"], r["s_end"], r["strand"], r["bits"]) for r in rows] == [(101, 200, "-", 55.5)]


def test_streams_parse_like_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "h.tsv").write_text(HITS)
    stream = streaming.stream_hits(spark, str(folder)).where(F.col("identity") >= 80)
    q = stream.writeStream.format("memory").queryName("hits_in").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("hits_in").count() == 1


def test_library_and_report(spark, tmp_path):
    t = spark.createDataFrame([("a", "f1", "g"), ("b", "f2", "g")], "element_id string, family string, superfamily string")
    src.write_library(t, str(tmp_path / "lib"))
    assert (tmp_path / "lib" / "superfamily=g" / "family=f1").is_dir()
    src.write_report(t, str(tmp_path / "rep"))
    assert "element_id\tfamily\tsuperfamily" in "".join(f.read_text() for f in (tmp_path / "rep").glob("part-*"))
