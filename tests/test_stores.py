"""Small stores: rebuilt communities, plans and logs in files, settings."""

import json
from unittest.mock import Mock

import pytest

from tarnsift.operators import community as M
from tarnsift.sources import shared
from tarnsift.sources.settings import ENV, Settings
from tarnsift.sources.tables import write_log, write_plan

MEMBERS = "level int, community_id string, page_id long"


def test_communities_are_rebuilt_from_themselves(spark, tmp_path):
    path = f"{tmp_path}/communities"
    first = spark.createDataFrame([(0, "a", 1), (0, "a", 2), (0, "b", 3)], MEMBERS)
    assert M.rebuild(spark, first, path).count() == 3
    # What is written is read from what it replaces.
    again = M.rebuild(spark, spark.read.parquet(path).where("community_id = 'a'"), path)
    assert sorted(map(tuple, again.collect())) == [(0, "a", 1), (0, "a", 2)]
    assert M.rebuild(spark, spark.createDataFrame([], MEMBERS), path).count() == 0


def test_communities_without_text_are_not_written(spark):
    rows = [("a", "text", "s", [1.0, 2.0]), ("b", " ", "s", [1.0, 2.0]), ("c", None, "s", [1.0, 2.0]), ("d", "text", "", [1.0, 2.0]), ("e", "text", None, None)]
    df = spark.createDataFrame(rows, "community_id string, sample string, summary string, embedded array<double>")
    assert [tuple(r) for r in M.written(df, 2).orderBy("community_id").collect()] == [("a", "s", [1.0, 2.0]), ("d", "", [0.0, 0.0]), ("e", None, [0.0, 0.0])]


def test_plans_and_logs_are_files(spark, tmp_path):
    plan = spark.createDataFrame([("steel", ["a", "b"], 3)], "winner string, losers array<string>, n long")
    write_plan(plan, f"{tmp_path}/plan")
    lines = [json.loads(x) for p in (tmp_path / "plan").glob("part-*") for x in p.read_text().splitlines()]
    assert lines == [{"winner": "steel", "losers": ["a", "b"], "n": 3}]
    write_log(spark.createDataFrame([(1, "old", "new")], "id long, was string, now string").coalesce(1), f"{tmp_path}/log")
    assert [p.read_text() for p in (tmp_path / "log").glob("part-*")] == ["id\twas\tnow\n1\told\tnew\n"]


def test_settings_come_from_a_file(spark, tmp_path, monkeypatch):
    assert Settings.load(tmp_path / "none.toml") == Settings()
    (tmp_path / "a.toml").write_text('[engine]\nrerank_pool = 7\ntime_zone = "UTC"\n[other]\nx = 1\n')
    monkeypatch.setenv(ENV, str(tmp_path / "a.toml"))
    assert Settings.load().rerank_pool == 7 and Settings.load().text_batch == 32
    (tmp_path / "b.toml").write_text("[engine]\nodd = 1\n")
    with pytest.raises(ValueError, match="odd"):
        Settings.load(tmp_path / "b.toml")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    Settings(shuffle_partitions=3).apply(spark)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_cluster_must_name_its_shared_folder():
    def session(master):
        unset = Mock()
        unset.isDefined.return_value = False
        s = Mock(conf={})
        s.sparkContext.master = master
        s.sparkContext._jsc.sc.return_value.getCheckpointDir.return_value = unset
        return s

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.folder_of(session(master))
    assert shared.folder_of(session("local[2]")).startswith("file://")
