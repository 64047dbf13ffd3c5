"""The native operators run no Python on their main path."""

import re

import pytest
from pyspark.sql import DataFrameWriter

from lorewright.llm import registry

SF = "/root/testdata/sf0.001"
PYTHON = r"ArrowEval|BatchEvalPython|MapInPandas|MapInArrow|FlatMap(?:Co)?Groups"


@pytest.mark.parametrize("name", ["op4_entropy_mixing", "op9_exact_dedup", "op13_decontamination"])
def test_native(spark, monkeypatch, name):
    plans, write = [], DataFrameWriter.parquet

    def parquet(self, path, *a, **k):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    plans.append(registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3
    for p in plans:
        assert not re.search(PYTHON, p) and "CartesianProduct" not in p


def test_every_operator_has_one_query_and_its_columns(spark):
    want = {
        2: "doc_id size text_crc32 law shard slot grown_shard", 4: "doc_id size source_size target taken", 5: "doc_id held_out n_tokens n_known train_tokens base_score score",
        6: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", 7: "page_id url text n_chars", 8: "doc_id fingerprint component_id",
        9: "doc_id keep_id group_size kept text_sha256", 10: "doc_id held_out score predicted",
        11: "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", 12: "lang source part item value rank",
        13: "doc_id n_words n_hit n_items items_sha256 contaminated",
    }
    names = {int(re.match(r"op(\d+)_", q)[1]): q for q in registry.queries()}
    assert sorted(names) == list(range(1, 14))
    for n, columns in want.items():
        df = registry.queries()[names[n]](spark, SF)
        assert set(columns.split()) <= set(df.columns), n
        if n in (11, 12):
            continue
        rows = spark.read.parquet(f"{SF}/{'pages' if n == 7 else 'documents'}.parquet").count()
        assert df.count() == rows
