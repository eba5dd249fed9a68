"""A whole query stream with drawn parameters, and golden answers where they are at hand."""

import os

import pytest
from pyspark.sql import types as T

from starmill.generator import parameters
from starmill.plans import star_suite
from starmill.plans.file_runs import run_stream
from starmill.plans.star_runs import drawn_arguments
from starmill.sources import files
from starmill.sources.star import Star


def test_stream_with_drawn_parameters(spark, star):
    drawn = parameters.query_parameters(spark.createDataFrame([(7,)], "seed bigint")).collect()
    arguments = {f"q{r.query:02d}": drawn_arguments(r.query, list(r.parameters)) for r in drawn}
    rows = run_stream(star, 0, arguments).collect()
    assert [r.query for r in sorted(rows, key=lambda r: r.position)][:4] == [14, 2, 9, 20]
    assert {r.query for r in rows} == set(range(1, 23))
    again = run_stream(star, 0, arguments).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


# Set both to check the suite against published answers: a folder of qN.out files, and
# a folder of tables generated at scale factor 1 with the full comment pool.
GOLDEN, FULL = os.environ.get("STAR_GOLDEN_DIR"), os.environ.get("STAR_SF1_DIR")


@pytest.mark.skipif(not (GOLDEN and FULL), reason="no golden answers named")
@pytest.mark.parametrize("number", [n for n in range(1, 23) if n != 16])
def test_golden_answers(spark, number):
    got = getattr(star_suite, f"q{number:02d}")(Star(spark, FULL))
    columns = T.StructType.fromDDL(
        ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in got.schema.fields))
    want = files.read_golden(spark, f"{GOLDEN}/q{number}.out", columns)
    assert want.count() > 0
    assert files.compare_answers(got, want, 0.0101).count() == 0
