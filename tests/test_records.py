import pytest

from cladeworks.sources import strict_records as r

CASES = [
    ("csv", 'f,1,s,d,ACGT\n', None), ("csv", 'f,1,s,"a, ""b""\nc",ACGT\r\n', None), ("csv", 'f,1,s,"open,ACGT', "quoting"), ("csv", 'f,1,s,"x"y,ACGT', "quoting"),
    ("csv", 'f,1,s,a"b,ACGT', "quoting"), ("csv", 'f,1,s,ACGT', "columns"), ("csv", "", "columns"), ("csv", None, "columns"), ("csv", "f,1, ,d,ACGT", "bad_id"),
    ("csv", "f,1,a b,d,ACGT", "bad_id"), ("csv", "f,x,s,d,ACGT", "bad_ord"), ("csv", "f,,s,d,ACGT", "bad_ord"), ("csv", "f, 7 ,s,d,AC GT", "bad_residues"),
    ("csv", "f,1,s,d,AC\nGT", "bad_residues"), ("csv", "f,1,s,d, acgt-_* ", None), ("csv", "f,1,s,d,", None), ("csv", "f,1,s,d,ACGO", "bad_residues"), ("csv", 'f,1,s,"x"\n,A', "quoting"),
    ("csv", ' "f",1,s,d,A', "quoting"), ("csv", "f,１,s,d,A", "bad_ord"), ("csv", "f," + "9" * 5000 + ",s,d,A", None),
    ("tsv", 'f\t1\ts\ta"b\tACGT\n\n', None), ("tsv", "f\t1\ts\tACGT", "columns"), ("tsv", "f\t1\ts\td\te\tACGT", "columns"), ("tsv", "f\t-1\ts\td\tACGT", "bad_ord"),
    ("fasta", ">s d\nAC\r\nGT\n", None), ("fasta", "s d\nACGT", "columns"), ("fasta", ">s\nAC\n>t\nGT", "columns"), ("fasta", "> s\nACGT", "bad_id"),
    ("fasta", ">s\n", None), ("fasta", ">s\nAC GT", "bad_residues"), ("fasta", ">s\n  ACGT\t\n\n-_*", None), (None, "x", "layout"), ("xml", "x", "layout"),
]


@pytest.mark.parametrize("layout, text, reason", CASES)
def test_reasons(layout, text, reason):
    assert r.parse(layout, text).get("reason") == reason


def test_values():
    got = r.parse("csv", 'f,007,s,"a, ""b""\nc", acgt ')
    assert got == {"family_id": "f", "ord": 7, "ord_text": "007", "seq_id": "s", "descr": 'a, "b"\nc', "residues": "acgt"}
    assert r.parse("fasta", ">s|1\td e\nAC\nGT")["descr"] == "d e"
    assert r.parse("csv", "f," + "9" * 30 + ",s,d,A")["ord"] is None
    long = "A" * 500_000
    assert r.parse("csv", f'f,1,s,"{"x" * 300_000}",{long}')["residues"] == long


def test_private_letters():
    """Any letter may stand in a text, all private-use ones at once too."""
    odd = "".join(map(chr, range(0xE000, 0xF900)))
    assert r.parse("csv", f'f,1,s,"{odd}\n\r",A')["descr"] == odd + "\n\r"


def test_assembly(spark, tmp_path):
    text = 'f,1,s,"a\nb ""q""",AC\r\nf,2,t,d"x,GT\nf,3,u,"open,A\nlast'
    assert list(r.assemble_lines(text.splitlines(keepends=True))) == ['f,1,s,"a\nb ""q""",AC\r\n', 'f,2,t,d"x,GT\n', 'f,3,u,"open,A\nlast']
    (tmp_path / "a.csv").write_text(text, newline="")
    raw = r.records_of_files(spark, str(tmp_path / "a.csv"), "csv").withColumnRenamed("place", "raw_id")
    assert {(x.raw_id, x.reason) for x in r.load_records(raw).collect()} == {(0, None), (1, "quoting"), (2, "quoting")}
    (tmp_path / "a.fasta").write_text(">s a>b\nAC\nGT\n>t\n")
    raw = r.records_of_files(spark, str(tmp_path / "a.fasta"), "fasta").withColumnRenamed("place", "raw_id")
    assert [(x.seq_id, x.descr, x.residues) for x in r.load_records(raw).collect()] == [("s", "a>b", "ACGT"), ("t", None, "")]


def test_table(spark):
    rows = [(i, k, t, "clash") for i, (k, t, _) in enumerate(CASES)]
    raw = spark.createDataFrame(rows + rows[:1], "raw_id long, layout string, raw_text string, reason string")
    valid, bad = r.split_valid(r.load_records(raw))
    assert {(x.raw_id, x.reason) for x in bad.collect()} == {(i, c[2]) for i, c in enumerate(CASES) if c[2]}
    assert valid.count() == sum(c[2] is None for c in CASES) + 1
    assert r.load_records(raw.limit(0)).count() == 0
