import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from backflow.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
    })
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


LINE_SCHEMA = (
    "customer_emailid string, sales_order_no string, order_date timestamp_ntz, q_sku_id string, sku string, sales_qty int, return_qty int, "
    "return_date timestamp_ntz, gross double, q_cls_id string, class_ string, return_no string, units_returned_flag string, line_no int"
)


@pytest.fixture(scope="session")
def make_lines(spark):
    """Lines from short dicts; unset columns get plain defaults."""
    from datetime import datetime

    def build(items):
        data = []
        for i, x in enumerate(items):
            sku = x.get("sku", "s1")
            back = x.get("back", 0)
            at = lambda v: datetime.fromisoformat(v) if v else None
            data.append((
                x.get("c", "a"), x.get("o", "o1"), at(x.get("at", "2024-01-01")), sku, sku, x.get("qty", 1), back, at(x.get("ret")),
                x.get("gross", 10.0), x.get("cat", "k1"), x.get("cls", "k1:x"), "n" if back else None, "Yes" if back else "No", i,
            ))
        return spark.createDataFrame(data, LINE_SCHEMA)

    return build
