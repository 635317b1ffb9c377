"""Registered queries outside the llm subpackage against their SQL twins on the smallest tables.

By default one or two of each family, for a quick run; ALL_QUERIES=1 takes every one.
"""

import math
import os

import duckdb
import pytest

from dayweave.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


QUICK = (
    "daily_features alerts streaming_alerts verified_claims prose_numbers classification_scores tau_sweep transition_matrix auroc_by_dataset fall_operating_point nearest_two identity_operating_point "
    "track_windows reachable_fragments voted_roles decoded_segments fused_posteriors skeleton_streams window_labels step_labels annotation_cross_check parsed_names segment_upsert "
    "nearest_two_blocks auroc_by_rank protocol_counts stray_subjects remapped_subjects masked_loss layout_votes pose_archive_check built_clips shard_audit dataset_profile path_classes observation_faults segment_wire top_deviations heaviest_chain keyword_classes"
).split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def same(a, b):
    return a == b or str(a) == str(b) or isinstance(a, int | float) and isinstance(b, int | float) and abs(a - b) <= 2e-5 * max(1, abs(a))


@pytest.mark.parametrize("name", QUERIES if os.environ.get("ALL_QUERIES") else QUICK)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    if name not in ORACLES:
        return
    res = duck.execute(ORACLES[name])
    order = [[d[0] for d in res.description].index(c) for c in cols]
    want = sorted(([plain(r[i]) for i in order] for r in res.fetchall()), key=str)
    assert len(rows) == len(want)
    assert all(same(x, y) for a, b in zip(rows, want) for x, y in zip(a, b))


def test_entry_imports_without_the_llm_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "dayweave"), tmp_path / "dayweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import re, __spark_entry__ as e; q = e.queries(); assert 'alerts' in q and 'pipeline' not in q and not any(re.match('op[0-9]', n) for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
