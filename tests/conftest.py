from __future__ import annotations

import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# The 1978 automobile data that regression manuals use: price, miles per gallon, weight, foreign.
_CARS = """
4099 22 2930 0;4749 17 3350 0;3799 22 2640 0;4816 20 3250 0;7827 15 4080 0;5788 18 3670 0;4453 26 2230 0;5189 20 3280 0
10372 16 3880 0;4082 19 3400 0;11385 14 4330 0;14500 14 3900 0;15906 21 4290 0;3299 29 2110 0;5705 16 3690 0
4504 22 3180 0;5104 22 3220 0;3667 24 2750 0;3955 19 3430 0;3984 30 2120 0;4010 18 3600 0;5886 16 3600 0;6342 17 3740 0
4389 28 1800 0;4187 21 2650 0;11497 12 4840 0;13594 12 4720 0;13466 14 3830 0;3829 22 2580 0;5379 14 4060 0
6165 15 3720 0;4516 18 3370 0;6303 14 4130 0;3291 20 2830 0;8814 21 4060 0;5172 19 3310 0;4733 19 3300 0;4890 18 3690 0
4181 19 3370 0;4195 24 2730 0;10371 16 4030 0;4647 28 3260 0;4425 34 1800 0;4482 25 2200 0;6486 26 2520 0;4060 18 3330 0
5798 18 3700 0;4934 18 3470 0;5222 19 3210 0;4723 19 3200 0;4424 19 3420 0;4172 24 2690 0;9690 17 2830 1;6295 23 2070 1
9735 25 2650 1;6229 23 2370 1;4589 35 2020 1;5079 24 2280 1;8129 21 2750 1;4296 21 2130 1;5799 25 2240 1;4499 28 1760 1
3995 30 1980 1;12990 14 3420 1;3895 26 1830 1;3798 35 2050 1;5899 18 2410 1;3748 31 2200 1;5719 18 2670 1;7140 23 2160 1
5397 41 2040 1;4697 25 1930 1;6850 25 1990 1;11995 17 3170 1
"""


@pytest.fixture(scope="session")
def cars(spark):
    rows = [tuple(map(float, car.split())) for line in _CARS.split("\n") for car in line.split(";") if car.strip()]
    frame = pd.DataFrame(rows, columns=["price", "mpg", "weight", "foreign"])
    frame["foreign_mpg"] = frame["foreign"] * frame["mpg"]
    frame.insert(0, "id", range(len(frame)))
    return spark.createDataFrame(frame).cache()
