import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gatecast.schemas import ETD_SCHEMA, LABELS_SCHEMA, LAMP_SCHEMA, MFS_SCHEMA  # noqa: E402
from gatecast.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def con():
    import duckdb
    c = duckdb.connect()
    for t in ("events", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=8, app_name="gatecast-tests")
    yield s
    s.stop()


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)


@pytest.fixture
def frames(spark):
    """Builders for the four inputs from plain tuples."""
    def labels(rows):
        return spark.createDataFrame([(g, ts(t), a, m) for g, t, a, m in rows], LABELS_SCHEMA)

    def etd(rows):
        return spark.createDataFrame(
            [(a, g, ts(t), ts(d) if d else None) for a, g, t, d in rows], ETD_SCHEMA)

    def lamp(rows):
        out = []
        for a, issue, fc, temp, *rest in rows:
            vals = dict(wind_direction=10.0, wind_speed=3.0, wind_gust=1.0, cloud_ceiling=2.0,
                        visibility=4.0, cloud="C1", lightning_prob="L1", precip="False")
            if rest:
                vals.update(rest[0])
            out.append((a, ts(issue), ts(fc), temp, vals["wind_direction"], vals["wind_speed"],
                        vals["wind_gust"], vals["cloud_ceiling"], vals["visibility"], vals["cloud"],
                        vals["lightning_prob"], vals["precip"]))
        return spark.createDataFrame(out, LAMP_SCHEMA)

    def mfs(rows):
        return spark.createDataFrame(rows, MFS_SCHEMA)

    return {"labels": labels, "etd": etd, "lamp": lamp, "mfs": mfs}
