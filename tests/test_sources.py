import pytest
from pyspark.errors import PythonException

from helixbench.sources import datasources, files


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_assays_of_differing_headers(spark, tmp_path):
    put(tmp_path / "a1.csv", "mutant,DMS_score,sequence\nA1G,1.5,GC\n,2,AC\n")
    put(tmp_path / "a2.csv", "extra,DMS_score,mutation\nx,nan,C2U\n")
    put(tmp_path / "a3.csv", "DMS_score,Mutations,mutations,DMS_score\n3,no,G1A,9\n")
    got = sorted(map(tuple, files.read_assays(spark, str(tmp_path)).collect()), key=str)
    assert got == [("a1", "A1G", 1.5, "GC"), ("a1", None, 2.0, "AC"), ("a2", "C2U", None, None), ("a3", "G1A", 3.0, None)]


def test_no_mutation_column(spark, tmp_path):
    put(tmp_path / "a1.csv", "x,DMS_score\n1,2\n")
    with pytest.raises(PythonException, match="no mutation column"):
        files.read_assays(spark, str(tmp_path)).collect()


def test_manifest(spark, tmp_path):
    put(tmp_path / "d" / "a1.csv", "mutant,DMS_score\nA1G,1\n")
    put(tmp_path / "d" / "a9.csv", "mutant,DMS_score\nA1G,1\n")
    sheet = spark.createDataFrame([("a1",), ("a2",)], "dms_id string")
    rows, missing = files.by_manifest(files.read_assays(spark, str(tmp_path / "d")), sheet, strict=False)
    assert [r.dms_id for r in rows.collect()] == ["a1"] and [r.dms_id for r in missing.collect()] == ["a2"]
    with pytest.raises(FileNotFoundError):
        files.by_manifest(files.read_assays(spark, str(tmp_path / "d")), sheet, strict=True)


def test_predictions(spark, tmp_path):
    put(tmp_path / "Evo" / "a1.csv", "mutation,scores\nA1G,0.5\n")
    put(tmp_path / "RNA_FM" / "a1.csv", "RNA_FM_scores,mutant,scores\n0.25,A1G,9\n")
    got = sorted(map(tuple, files.read_predictions(spark, str(tmp_path), ["Evo", "RNA_FM"]).collect()))
    assert got == [("Evo", "a1", "A1G", 0.5), ("RNA_FM", "a1", "A1G", 0.25)]


def test_sheet_layouts_and_encodings(spark, tmp_path):
    put(tmp_path / "new.csv", 'DMS_ID,YEAR,AUTHOR,RNA_TYPE,TITLE\na1,2020,"Müller, A",tRNA,"two\nlines"\n')
    put(tmp_path / "old.csv", "fitness filename,Year,First Author Last Name,Raw Construct Sequence (DNA)\na2,2019,Pérez,ACGT\n", "latin-1")
    new = files.read_sheet(spark, str(tmp_path / "new.csv")).first()
    assert (new.dms_id, new.year, new.author, new.rna_type, new.title, new.pdb_structure) == ("a1", 2020, "Müller, A", "tRNA", "two\nlines", None)
    old = files.read_sheet(spark, str(tmp_path / "old.csv"), "ISO-8859-1").first()
    assert (old.dms_id, old.author, old.raw_construct_seq) == ("a2", "Pérez", "ACGT")


def test_connect_tables(spark, tmp_path):
    put(tmp_path / "x.ct", "4 a name\n1 G 0 2 4 1\n2 A 1 3 0 2\n3 U 2 4 0 3\n4 C 3 0 1 4\n")
    sequences, pairs = files.read_ct(spark, str(tmp_path / "*.ct"))
    assert sequences.first().sequence == "GAUC"
    assert [(r.i, r.j) for r in pairs.collect()] == [(0, 3)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "A1G", 1.0, "val"), ("b", "A1C", 2.0, "train")], "dms_id string, mutant string, dms_score double, fold string")
    files.write_assays(df, str(tmp_path / "w"))
    assert spark.read.option("header", True).csv(str(tmp_path / "w")).where("dms_id = 'a'").count() == 1
    files.write_split(df, str(tmp_path / "s"), "random")
    assert (tmp_path / "s" / "random" / "val" / "a_val.csv").read_text() == "mutant,dms_score\nA1G,1.0\n"
    assert sorted(p.name for p in (tmp_path / "s").rglob("*.csv")) == ["a_val.csv", "b_train.csv"]
    got = files.read_split(spark, str(tmp_path / "s"), "random", "mutant string, dms_score double")
    assert sorted(map(tuple, got.collect())) == [("a", "val", "A1G", 1.0), ("b", "train", "A1C", 2.0)]
    for run in ("x", "x", "y"):
        files.append_result(df, str(tmp_path / "r"), run)
    assert sorted((r.run, r.dms_id) for r in files.read_results(spark, str(tmp_path / "r")).collect()) == [("x", "a"), ("x", "b"), ("y", "a"), ("y", "b")]
    put(tmp_path / "l.tsv", "seqs\tscores\nACG\t-1.5\n")
    assert tuple(files.read_likelihoods(spark, str(tmp_path / "l.tsv")).first()) == ("ACG", -1.5)
    assert files.lower_columns(df.withColumnRenamed("mutant", "Mutant")).columns[1] == "mutant"


def test_models_without_files_and_written_assays(spark, tmp_path):
    df = spark.createDataFrame([("a", "A1G", 1.0), ("b b", None, 2.0)], "dms_id string, mutant string, scores double")
    files.write_assays(df, str(tmp_path / "Evo"))
    with pytest.warns(UserWarning, match="GenSLM"):
        got = files.read_predictions(spark, str(tmp_path), ["GenSLM", "Evo"])
    assert sorted(map(tuple, got.collect()), key=str) == [("Evo", "a", "A1G", 1.0), ("Evo", "b b", None, 2.0)]
    with pytest.warns(UserWarning):
        assert files.read_predictions(spark, str(tmp_path), ["GenSLM"]).count() == 0


def test_tables_under_their_own_names(spark, tmp_path):
    spark.createDataFrame([("ACG", "p1", "(.)", 1)], "sequence string, method string, dotbracket string, more int").write.parquet(str(tmp_path / "s"))
    assert tuple(files.read_structures(spark, str(tmp_path / "s")).first()) == ("ACG", "p1", "(.)")
    put(tmp_path / "p.csv", "position_id,prediction_m,sequence_id,sequence\n3,nan,s1,ACG\n4,0.5,s1,ACG\n")
    got = files.read_position_predictions(spark, str(tmp_path / "p.csv"), "m")
    assert sorted(map(tuple, got.collect()), key=str) == [("ACG", "s1", 3, None), ("ACG", "s1", 4, 0.5)]


def test_a_failed_writer_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", "val", 1), ("b", "val", 0)], "dms_id string, fold string, x int")
    files.write_split(df, str(tmp_path), "kept")
    with pytest.raises(Exception):
        files.write_split(df.selectExpr("dms_id", "fold", "1 div x AS x"), str(tmp_path), "lost")
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")) == ["kept/val/a_val.csv", "kept/val/b_val.csv"]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_staging")]


def test_a_killed_append_is_not_read(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "dms_id string, x double")
    folder = str(tmp_path / "r")
    assert files.read_results(spark, folder) is None
    df.withColumn("run", df.dms_id).write.partitionBy("run").parquet(folder)  # rows that were written, the list was not
    assert files.read_results(spark, folder) is None
    files.append_result(df, folder, "b")
    assert [(r.run, r.x) for r in files.read_results(spark, folder).collect()] == [("b", 1.0)]
    files.append_result(df, folder, "a")
    assert files.read_results(spark, folder).count() == 2


def test_bad_cells_and_lines_are_reported(spark, tmp_path):
    put(tmp_path / "l.csv", "Usage,id,reactivity_DMS_MaP,more\nPrivate,1,0.5,x\nPublic,z2,nan,x\nPublic,3,high,x\nPublic,4\n,5,,x\n")
    path = str(tmp_path / "l.csv")
    assert sorted((r.id, r.reactivity) for r in files.read_labels(spark, path).where("id is not null").collect()) == [(1, 0.5), (3, None), (5, None)]
    assert sorted(map(tuple, files.label_rejects(spark, path).collect()), key=str) == [("id", "z2"), ("reactivity", "high"), (None, "Public,4")]
    put(tmp_path / "f" / "a.csv", "mutant,DMS_score\nA1G,1,5\nC2U,none\n")
    wanted = {"mutant": "string", "dms_score": "double"}
    assert list(map(tuple, files.rejected_cells(files.raw_csvs(spark, str(tmp_path / "f"), wanted), wanted, ["dms_id"]).collect())) == [("a", "dms_score", "none")]


def test_reading_plans_packs_of_files(spark, tmp_path):
    for i in range(30):
        put(tmp_path / f"a{i}.csv", f"DMS_score,x,mutation\n{i},1,A1G\n")
    df = files.read_assays(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 1 and sorted(r.dms_score for r in df.collect()) == [float(i) for i in range(30)]
    with pytest.raises(FileNotFoundError):
        files.read_assays(spark, str(tmp_path / "none"))


def test_written_assays_come_back_as_they_were(spark, tmp_path):
    rows = [("a/b c", 'say "x", y', " 1 "), ("a/b c", "two\nlines", None), ("ü%2", "A1G", "2.5")]
    df = spark.createDataFrame(rows, "dms_id string, mutant string, note string")
    read = lambda: sorted(map(tuple, files.read_csvs(spark, str(tmp_path / "w"), {"mutant": "string", "note": "string"}).drop("path").collect()), key=str)
    files.write_assays(df, str(tmp_path / "w"))
    files.write_assays(df, str(tmp_path / "w"))
    assert read() == sorted(rows, key=str)
    files.write_assays(df.where("note is null"), str(tmp_path / "w"), mode="append")
    assert read() == sorted([*rows, rows[1]], key=str)
    assert len(list((tmp_path / "w").iterdir())) == 2 and not [p for p in (tmp_path / "w").rglob("*") if p.is_file() and p.suffix != ".csv"]


def test_small_files_are_read_into_common_batches(tmp_path):
    for i in range(30):
        put(tmp_path / f"a{i}.csv", "DMS_score,mutation\n" + f"{i},A1G\n" * 10)
    reader = datasources.AssayReader(str(tmp_path), ["mutant", "dms_score"], 128)
    (pack,) = reader.partitions()
    batches = list(reader.read(pack))
    assert [b.num_rows for b in batches] == [128, 128, 44] and sorted({r["dms_id"] + r["dms_score"] for b in batches for r in b.to_pylist()}) == sorted(f"a{i}{i}" for i in range(30))


def test_split_files_are_read_in_packs_with_any_cells(spark, tmp_path):
    rows = [(f"a_{i}", fold, f'm{i} "x",\ny', i / 4) for i in range(20) for fold in ("val", "train")] + [("b +%", "val", None, None)]
    df = spark.createDataFrame(rows, "dms_id string, fold string, mutant string, x double")
    files.write_split(df, str(tmp_path), "random")
    got = files.read_split(spark, str(tmp_path), "random", "mutant string, x double")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str) and got.rdd.getNumPartitions() == 1
