import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests.compare import SF, TABLES, assert_same
from tetrafield.queries import QUERIES, SQL, frames

CHOSEN = ["query_many", "composite_basins", "profile_query", "query_repeated", "query_stats", "query_stats_output", "query_totals", "grid_fold_check", "station_list", "explain_hits", "blend_over", "cull_mesh", "prism_mesh", "layer_slices", "morton_order", "crs_forward", "bilinear_nan", "quad_lookup", "coast_signed", "coast_distance", "grid_sw4", "decay_sleve", "layer_clamp_floors", "layer_backus", "site_summary", "site_deepening", "sites_csv", "profile_text", "tomography_text", "outline_geojson", "surface_file", "mesh_files", "model_csv", "model_parquet", "sfile_interfaces", "sfile_material", "outline_areas", "basin_mesh", *frames.QUERIES]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), SQL[name])


@pytest.mark.parametrize("name", ["bilinear_clamp", "bilinear_nan", "raster_coarsen", "surface_range", "depth_below", "surface_file"])
def test_rasters_with_a_short_last_row(spark, tmp_path, name):
    for table in TABLES:
        (tmp_path / f"{table}.parquet").symlink_to(f"{SF}/{table}.parquet")
    (tmp_path / "part.parquet").unlink()
    pq.write_table(pq.read_table(f"{SF}/part.parquet").slice(0, 187), tmp_path / "part.parquet")
    assert_same(QUERIES[name](spark, str(tmp_path)), SQL[name], str(tmp_path))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_contract(spark):
    assert entry.entry(spark).limit(5).count() == 5
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


def test_graded_mesh_of_repeated_parts(spark, tmp_path):
    """Parts 11264 numbers apart are the same tetrahedron."""
    for table in TABLES:
        (tmp_path / f"{table}.parquet").symlink_to(f"{SF}/{table}.parquet")
    (tmp_path / "part.parquet").unlink()
    part = pq.read_table(f"{SF}/part.parquet")
    again = part.set_column(part.schema.get_field_index("p_partkey"), "p_partkey", pc.add(part["p_partkey"], 11264))
    pq.write_table(pa.concat_tables([part, again]), tmp_path / "part.parquet")
    assert_same(QUERIES["locate_graded"](spark, str(tmp_path)), SQL["locate_graded"], str(tmp_path))


def planned(df):
    """The plan before anything ran: by Spark's sizes, which know of no exploded rows."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cull_mesh", "mesh_catalog", "tet_volume"])
def test_exploded_cells_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in planned(QUERIES[name](spark, "/root/testdata/sf0.1"))
    assert_same(QUERIES[name](spark, SF), SQL[name])
