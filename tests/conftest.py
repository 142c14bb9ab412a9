import pandas as pd
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.driver.memory", "3g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def star():
    """A small star: sales with products, customers (with regions), dates and promotions."""
    return {
        "Product": pd.DataFrame({"product_id": [1, 2, 3], "category": ["Electronics", "Home", "Other"], "cost": [300.0, 15, 500]}),
        "Customer": pd.DataFrame({"customer_id": [100, 101, 102, 103], "customer_name": ["Acme Co", "Globex", "Initech", "Umbrella"], "segment": ["SMB", "Enterprise", "SMB", "Consumer"], "region_id": [7, 8, 7, 9]}),
        "Region": pd.DataFrame({"region_id": [7, 8, 9], "region": ["North", "West", "South"]}),
        "Calendar": pd.DataFrame({"date": [f"2024-01-0{d}" for d in range(1, 6)], "month": ["2024-01"] * 5}),
        "Sales": pd.DataFrame({"sale_id": range(10, 16), "product_id": [1, 1, 2, 3, 2, 1], "customer_id": [100, 101, 102, 103, 100, 102], "date": ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", "2024-01-03"], "promo_code": ["NEW10", "NONE", "DISC5", "NONE", "DISC5", "NEW10"], "qty": [2, 1, 4, 3, 5, 2], "price": [500.0, 500, 25, 800, 25, 500]}),
        "Promos": pd.DataFrame({"promo_code": ["NEW10", "DISC5", "NONE"], "promo_type": ["Launch", "Discount", "No Promo"]}),
    }


@pytest.fixture(scope="session", params=[False, True], ids=["lazy", "stored"])
def loaded(spark, star, request):
    from starloom import Hypercube

    return Hypercube(star, normalized_core=request.param, spark=spark)


@pytest.fixture
def cube(loaded):
    """The star's cube with fresh states and definitions."""
    from starloom.plans.state import ContextState

    cube = loaded
    cube.reset_specs()
    cube.context_states = {"Unfiltered": ContextState(), "Default": ContextState()}
    cube.define_metric("Revenue", "[qty] * [price]", "sum")
    cube.define_metric("Units", "[qty]", "sum")
    cube.define_metric("Margin", "([price] - [cost]) * [qty]", "sum")
    cube.define_metric("Number of Sales", "[sale_id]", "count")
    cube.define_query("sales", ["region", "category", "promo_type"], ["Revenue", "Units", "Margin", "Number of Sales"])
    return cube
