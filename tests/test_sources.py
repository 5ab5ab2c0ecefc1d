import pytest
from pyspark.sql import functions as F

from secretsieve.operators import extract
from secretsieve.schemas import LABELLED
from secretsieve.sources import readers, sinks

TEXTS = ['plain', 'two\nlines "quoted", and, commas', '"', "", "back\\slash \\\" mixed", "  kept  ", "é\r\n😀", "null"]


def labelled(spark):
    return spark.createDataFrame([(str(i), text, "c", i % 2) for i, text in enumerate(TEXTS)], LABELLED)


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_round_trip(spark, tmp_path, kind):
    path = str(tmp_path / f"rows.{kind}")
    if kind == "csv":
        sinks.append_csv(labelled(spark), path)
    else:
        getattr(labelled(spark).write, kind)(path)
    got = {r["issue_id"]: r["text"] for r in readers.read_dataset(spark, path, LABELLED).collect()}
    # CSV has no empty text.
    assert got == {str(i): (text or None) if kind == "csv" else text for i, text in enumerate(TEXTS)}


def test_unknown_extension(spark):
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "/data/rows.xlsx")


def test_catalog(spark):
    rows = [("p1", " Key ", " k[0-9] "), ("p2", None, "t+"), ("p3", "Bad", "("), ("p4", "None", None), ("p5", "", "  "), ("p6", " ", "z")]
    catalog = spark.createDataFrame(rows, "pattern_id string, secret_type string, pattern string")
    rules = readers.load_rules(catalog)
    assert [(r.name, r.pattern) for r in rules] == [("Key", "k[0-9]"), ("Pattern_2", "t+"), ("Pattern_6", "z")]
    assert readers.java_pattern(r"(?P<a_b>x)(?P=a_b)\Z") == r"(?<ab>x)\k<ab>\z"
    assert readers.compiles(spark, readers.java_pattern(r"(?P<key>\w+\s)\d\Z"))
    hits = extract.first_match_scan(spark.createDataFrame([(1, "x K7 tt")], "issue_id int, body string"), rules)
    assert hits.first()["secret_type"] == "Key"


def test_csv_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(',Issue_id,text,candidate_string,label\n0,i1,"the\ntext",c,1\n1,i2,t,c,maybe\n')
    (tmp_path / "b.csv").write_text('label,candidate_string,extra,TEXT,issue_id\n0,c,x,t,i3\n')
    a = readers.read_csv_dataset(spark, str(tmp_path / "a.csv")).collect()
    assert sorted(map(tuple, a)) == [("i1", "the\ntext", "c", 1), ("i2", "t", "c", None)]
    assert tuple(readers.read_csv_dataset(spark, str(tmp_path / "b.csv")).first()) == ("i3", "t", "c", 0)
    (tmp_path / "c.csv").write_text("text\nx\n")
    with pytest.raises(KeyError):
        readers.read_csv_dataset(spark, str(tmp_path / "c.csv"))


def test_array_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('[\n  {"full_name": "o/n", "size": 7, "stars": 2,\n "language": null},\n {"full_name": "p/q"}\n]')
    rows = {r["full_name"]: r["size_kb"] for r in readers.read_repos(spark, str(tmp_path / "r.json")).collect()}
    assert rows == {"o/n": 7, "p/q": None}
    (tmp_path / "l.json").write_text('{"full_name": "a", "size_kb": 1}\n{"full_name": "b", "size": 2}\n')
    assert {r["size_kb"] for r in readers.read_repos(spark, str(tmp_path / "l.json")).collect()} == {1, 2}


def test_folders_of_both_kinds(spark, tmp_path):
    """A file of lines beside a file that is one array: every record, whatever the sizes."""
    for n_array, n_lines, name in ((30, 3, "a b"), (2, 50, "c")):
        folder = tmp_path / name
        folder.mkdir()
        array = ",\n".join(f'  {{"full_name": "a{i}",\n   "size": {i}}}' for i in range(n_array))
        (folder / "array.json").write_text(f"\n \n[\n{array}\n]\n")
        (folder / "lines.json").write_text("".join(f'{{"full_name": "l{i}", "size_kb": {i}}}\n' for i in range(n_lines)))
        (folder / "empty.json").write_text("")
        rows = {r["full_name"]: r["size_kb"] for r in readers.read_repos(spark, str(folder)).collect()}
        assert rows == {f"a{i}": i for i in range(n_array)} | {f"l{i}": i for i in range(n_lines)}
    (tmp_path / "d.json").write_text('[{"issue_id": "1", "text": "t", "candidate_string": "c", "label": 1}]')
    assert tuple(readers.read_dataset(spark, str(tmp_path / "d.json"), LABELLED).first()) == ("1", "t", "c", 1)
    assert readers.read_dataset(spark, str(tmp_path / "c" / "lines.json")).columns == ["full_name", "size_kb"]


def test_a_repeated_run_leaves_one_copy(spark, tmp_path):
    path, hits = str(tmp_path / "hits"), spark.createDataFrame([("u1",), ("u2",)], "url string")
    for run in ("a", "b", "a", "a"):
        sinks.append_hits(hits, path, run)
    assert sorted(map(tuple, spark.read.parquet(path).groupBy("run_id").count().collect())) == [("a", 2), ("b", 2)]


def test_progress_comes_from_the_write(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Secret"), (2, None), (3, "Non-sensitive")], "id int, predicted_label string").repartition(3)
    assert sinks.write_with_progress(rows, str(tmp_path / "out")) == {"total": 3, "done": 2, "remaining": 1}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_url_list(spark, tmp_path):
    (tmp_path / "urls.txt").write_text(" a \n\nb\na\n   \n")
    assert sorted(r["url"] for r in readers.read_url_list(spark, str(tmp_path / "urls.txt")).collect()) == ["a", "b"]


def test_metadata(spark, tmp_path):
    (tmp_path / "i.json").write_text(
        '{"repo_full_name": "o/n", "title": "t", "labels": ["x"], "created_at": "2020-01-02T03:04:05Z", "closed_at": "soon"}\n')
    row = readers.read_issue_metadata(spark, str(tmp_path / "i.json")).select(F.unix_timestamp("created_at"), "closed_at", "updated_at").first()
    assert tuple(row) == (1577934245, None, None)
    assert readers.read_repos(spark, str(tmp_path / "none.json")).count() == 0


def test_sinks_append_and_partition(spark, tmp_path):
    hits = spark.createDataFrame([("u1",), ("u2",)], "url string")
    for _ in range(2):
        sinks.append_hits(hits, str(tmp_path / "hits"))
    assert spark.read.parquet(str(tmp_path / "hits")).count() == 4
    tagged = spark.createDataFrame([("Correct", 1), ("False Positive", 2)], "error_type string, i int")
    sinks.write_by_error(tagged, str(tmp_path / "errors"))
    assert (tmp_path / "errors" / "error_type=Correct").is_dir()
    sinks.write_by_split(tagged.withColumn("split", F.lit("test")), str(tmp_path / "splits"))
    sinks.write_summary(tagged, str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).count() == 2 and spark.read.parquet(str(tmp_path / "splits")).count() == 2
