import pytest

from quire.__main__ import main
from quire.plans import profiles


def test_explicit_wins():
    options, why = profiles.apply_plan("technical", {"chunk_tokens": 256, "top_k": 3}, {"top_k": 9})
    assert (options.chunk_tokens, options.top_k, options.domain) == (256, 9, "nvme")
    assert (why["chunk_tokens"], why["top_k"], why["domain"]) == ("plan", "explicit", "profile")
    with pytest.raises(ValueError):
        profiles.apply_plan("fast", {"nothing": 1}, {})
    assert [profiles.window_pages(*x) for x in ((10, 0, 0), (500, 2, 1), (500, 0, 0))] == [10, 25, 100]


def test_cli(spark, tmp_path, capsys):
    assert main([]) == 0 and "retrieve_topk" in capsys.readouterr().out
    assert main(["corpus_diff", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path)]) == 0
    assert spark.read.parquet(str(tmp_path / "corpus_diff")).count() > 0
