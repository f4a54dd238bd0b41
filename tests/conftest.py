import os
import sys
from datetime import date

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


RACE = ("race_id long, date date, course string, race_number int, surface string, distance int, direction string, grade string, "
        "race_class string, track_condition string, weather string, weather_forecast string, n_entries int, n_starters int, "
        "prize long, corner_nos array<int>, weight_rule string, meeting_no int, meeting_day int")
RUNNER = ("race_id long, horse_id long, number int, frame int, jockey_id long, trainer_id long, owner_id long, weight_carried double, "
          "horse_weight int, weight_diff int, age int, sex string, odds_win double, popularity int, status string, finish_pos int, "
          "margin string, time_sec double, last_3f double, corners array<int>, affiliation string")
HORSE = "horse_id long, sire_id long, damsire_id long"


def names(schema):
    import re
    return re.findall(r"(\w+) (?:array<int>|\w+)(?:, |$)", schema)


def race(race_id, day, **values):
    base = dict(race_id=race_id, date=day, course="東京", race_number=1, surface="芝", distance=1600, direction="左", grade=None,
                race_class="1勝クラス", track_condition="良", weather="晴", weather_forecast=None, n_entries=2, n_starters=2, prize=1000,
                corner_nos=[1, 2, 3, 4], weight_rule="定量", meeting_no=1, meeting_day=1)
    return base | values


def runner(race_id, horse_id, **values):
    base = dict(race_id=race_id, horse_id=horse_id, number=horse_id, frame=1, jockey_id=1, trainer_id=1, owner_id=1, weight_carried=55.0,
                horse_weight=480, weight_diff=0, age=4, sex="牡", odds_win=3.0, popularity=1, status="出走", finish_pos=1, margin="",
                time_sec=95.0, last_3f=35.0, corners=[1, 1, 1, 1], affiliation="東")
    return base | values


def rows_of(spark, schema, rows):
    order = names(schema)
    return spark.createDataFrame([tuple(r[c] for c in order) for r in rows], schema)


@pytest.fixture()
def event_tables(spark):
    def build(races, runners, horses=None):
        ids = sorted({r["horse_id"] for r in runners})
        horses = horses or [dict(horse_id=i, sire_id=100, damsire_id=200) for i in ids]
        return {"races": rows_of(spark, RACE, races), "runners": rows_of(spark, RUNNER, runners), "horses": rows_of(spark, HORSE, horses)}
    return build


@pytest.fixture()
def by_key():
    def collect(df, *columns):
        return {(r["race_id"], r["horse_id"]): (r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)) for r in df.collect()}
    return collect


D = [date(2020, 1, d) for d in range(1, 29)]
