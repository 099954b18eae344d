import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelmeter.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", 4, "tests", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def make_cells(n_items=12, n_raters=7, seed=0, missing=0.2):
    """A small panel with an item all pass, one all fail, and a rater with one cell."""
    rng = np.random.RandomState(seed)
    b, t = rng.normal(size=n_items), rng.normal(size=n_raters)
    rows = []
    for i in range(n_items):
        for j in range(n_raters):
            if j == n_raters - 1 and i != 3:
                continue
            if rng.rand() < missing and i > 3:
                continue
            y = int(rng.rand() < 1 / (1 + np.exp(-(t[j] - b[i]))))
            y = 1 if i == 0 else 0 if i == 1 else y
            rows.append((f"i{i:02d}", f"r{j}", y))
    return pd.DataFrame(rows, columns=["item", "rater", "y"])


@pytest.fixture(scope="session")
def cells_pdf():
    return make_cells()


@pytest.fixture(scope="session")
def cells(spark, cells_pdf):
    return spark.createDataFrame(cells_pdf).cache()


@pytest.fixture(scope="session")
def types(spark, cells_pdf):
    items = sorted(cells_pdf["item"].unique())
    return spark.createDataFrame([(i, f"t{k % 3}") for k, i in enumerate(items)],
                                 "item string, item_type string").cache()
