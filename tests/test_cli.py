from nimbusvec import cli
from nimbusvec.operators.exact import knn
from nimbusvec.sources import vector_files
from nimbusvec.sources.synthetic import synthetic


def test_build_and_search(spark, tmp_path):
    v = synthetic(spark, 120, 8, first_id=0)
    data, truth, index = str(tmp_path / "base.fbin"), str(tmp_path / "truth.bin"), str(tmp_path / "index")
    vector_files.write_vectors(v, data)
    vector_files.write_ground_truth(knn(v, v.withColumnRenamed("id", "qid"), 10), truth)
    out = cli.main(["build", "--data", str(tmp_path), "--output", index, "--queries", data, "--ground-truth", truth, "--shard-files", "-R", "12", "--bits", "8"], spark)
    assert out["recall@10"] > 0.95 and out["self_recall"] > 0.95 and out["max_degree"] <= 12 and out["num_vectors"] == 120
    found = str(tmp_path / "found.bin")
    cli.main(["search", "--index", index, "--queries", data, "--output", found], spark)
    assert vector_files.read_ground_truth(spark, found, 120).count() == 120


def test_no_batch_begins_that_would_end_late():
    usual = [0.0]
    steps = cli._steps(0, 60.0, usual)
    assert next(steps) == 0
    usual[0] = 100.0
    assert list(steps) == []
    assert list(cli._steps(3, None, usual)) == [0, 1, 2]


def test_bench(spark, tmp_path):
    out = cli.main(["bench", "--dim", "8", "--batch", "16", "--batches", "2", "--report", str(tmp_path / "r.json")], spark)
    assert out["meta"]["throughput"] > 0 and "query_breakdown" in out and "insert_breakdown" in out


def test_readers_and_writer_at_once(spark):
    out = cli.main(["bench", "--dim", "8", "--batch", "16", "--batches", "5", "--readers", "2", "--read-ratio", "0.6"], spark)
    assert out["query_breakdown"]["end_to_end_ns"]["count"] == 3 and out["insert_breakdown"]["end_to_end_ns"]["count"] == 2
    assert out["meta"]["num_vectors"] == 4 * 16 + 2 * 16 and out["meta"]["version"] == 2
