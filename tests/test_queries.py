"""Registered queries against their DuckDB twins on the smallest tables, and the entry without its optional parts."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from framequarry.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Steps of the star chain that star_full_analysis runs as well.
CHAIN = {"star_bg_mesh", "star_mesh_smooth", "star_threshold", "star_area_filter", "star_moments", "star_quality_cuts", "star_hfr", "star_summary"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def shown(v):
    return f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - CHAIN))
def test_twin(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    r = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(shown, row)) for row in r.fetchall())
    assert sorted(tuple(shown(row[c]) for c in names) for row in df.collect()) == want


def test_queries_without_twin_are_tested_elsewhere():
    """Their operators are compared with plain loops in test_files."""
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"bg_surface_fit", "psf_star_gate", "psf_adaptive_moments", "psf_topk_spaced", "psf_zone_summary_stars"}


def test_gate_picks_some_candidates(spark):
    q = catalog.queries()
    gated = q["psf_star_gate"](spark, "/root/testdata/sf0.01").count()
    measured, best = q["psf_adaptive_moments"](spark, "/root/testdata/sf0.01").collect(), q["psf_topk_spaced"](spark, "/root/testdata/sf0.01").collect()
    assert gated >= len(measured) >= len(best) > 0
    assert all(sum((r.frame_id, r.gy, r.gx) == (s.frame_id, s.gy, s.gx) for s in best) <= 2 for r in best)


def test_surface_fit_leaves_cells_out(spark):
    q = catalog.queries()
    first = {(r.frame_id, r.i, r.j): r.surface for r in q["bg_surface_first"](spark, SF).collect()}
    last = {(r.frame_id, r.i, r.j): r.surface for r in q["bg_surface_fit"](spark, SF).collect()}
    assert first.keys() == last.keys() and any(abs(first[k] - last[k]) > 1e-6 for k in first)


def test_entry_without_training_data_parts(tmp_path):
    for part in ("__spark_entry__.py", "framequarry"):
        os.symlink(f"{ROOT}/{part}", tmp_path / part) if part.endswith(".py") else None
    (tmp_path / "framequarry").mkdir()
    for part in os.listdir(f"{ROOT}/framequarry"):
        if part not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/framequarry/{part}", tmp_path / "framequarry" / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_zone_summary_counts_every_measured_star(spark):
    q = catalog.queries()
    zones, stars = q["psf_zone_summary_stars"](spark, SF).collect(), q["psf_topk_spaced"](spark, SF).count()
    assert sum(z.n for z in zones) == stars > 0
