import json

import pytest
from pyspark.sql import functions as F

from dwellspark.functions import display as D
from dwellspark.functions.phrases import PHRASES, structured_text
from dwellspark.operators.records import build_points, listing_to_record, nested_point, payload_json, project_response
from dwellspark.schema import LISTING

EMPTY = {f.name: None for f in LISTING}


def listings(spark, *rows):
    return spark.createDataFrame([tuple({**EMPTY, "id": 1, "external_id": "k", "description": "d", **r}[n] for n in LISTING.names) for r in rows], LISTING)


def sentence(spark, **fields):
    from decimal import Decimal

    if "rooms" in fields:
        fields["rooms"] = Decimal(fields["rooms"])
    return listings(spark, fields).select(structured_text()).first()[0]


@pytest.mark.parametrize(
    "fields, text",
    [
        ({"rooms": "6.0", "city": "City Q", "neighborhood": "Hill"}, "6 חדרים, City Q, Hill"),
        ({"rooms": "7.5", "has_parking": True, "has_elevator": True, "furnished": True}, "7.5 חדרים, עם חניה, עם מעלית, מרוהט"),
        ({"price": 71250}, "71,250 ש״ח"),
        ({"price": 0}, "0 ש״ח"),
        ({"price": 1234567}, "1,234,567 ש״ח"),
        ({"size_sqm": 217}, "217 מ״ר"),
        ({"size_sqm": 0}, "דירה"),
        ({"floor": 0}, "קרקע"),
        ({"floor": 14}, "קומה 14"),
        ({"floor": -4}, "קומה 4 למטה"),
        ({"neighborhood": "N", "location": "L"}, "N"),
        ({"neighborhood": "", "location": "L"}, "L"),
        ({"city": "", "location": ""}, "דירה"),
        ({}, "דירה"),
        ({"has_storage": True, "has_balcony": True, "total_floors": 9, "pets_allowed": True}, "עם מרפסת, עם מחסן"),
        ({"has_parking": False, "furnished": False}, "דירה"),
    ],
)
def test_structured_text(spark, fields, text):
    assert sentence(spark, **fields) == text


def test_phrases_can_be_exchanged(spark):
    words = {**PHRASES, "rooms": "{} rooms", "price": "{} USD"}
    df = listings(spark, {"price": 1000}).withColumn("rooms", F.lit(2.0))
    assert df.select(structured_text(words)).first()[0] == "2 rooms, 1,000 USD"


def payload(spark, **fields):
    return json.loads(listings(spark, fields).select(payload_json()).first()[0])


def test_payload_leaves_absent_keys_out(spark):
    found = payload(spark, id=777, city="", location=None)
    assert found == {
        "listing_id": 777, "external_id": "k", "has_parking": False, "has_elevator": False, "has_balcony": False,
        "has_storage": False, "furnished": False,
    }


def test_payload_with_everything(spark):
    from decimal import Decimal

    found = payload(
        spark, price=4321, rooms=Decimal("5.5"), size_sqm=98, floor=0, total_floors=4, city="c", location="l", neighborhood="n",
        has_parking=True, furnished=True, pets_allowed=False,
    )
    assert len(found) == 16 and found["rooms"] == 5.5 and found["floor"] == 0 and found["pets_allowed"] is False


def test_pets_are_tri_state(spark):
    assert "pets_allowed" not in payload(spark)
    assert payload(spark, pets_allowed=True)["pets_allowed"] is True


def test_point_shape(spark):
    df = listings(spark, {"id": 5}).withColumns(
        {"structured_vector": F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)), "description_vector": F.array(F.lit(3.0), F.lit(4.0), F.lit(5.0))}
    )
    point = build_points(df).select(nested_point().alias("p")).first().p.asDict(True)
    assert point["id"] == 5 and point["vector"] == {"structured": [0.5, 1.0, 2.0], "description": [3.0, 4.0, 5.0]}
    assert point["payload"]["listing_id"] == 5


def test_record_export(spark):
    from datetime import datetime, timezone
    from decimal import Decimal

    times = {"created_at": datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc), "updated_at": datetime(2024, 1, 2, 3, 4, 5, 60, tzinfo=timezone.utc)}
    rows = listings(spark, {"rooms": Decimal("2.5"), **times}, {"rooms": Decimal("0.0")})
    first, second = listing_to_record(rows).collect()
    assert first.rooms == 2.5 and second.rooms is None
    assert first.created_at == "2024-01-02T03:04:05+00:00" and first.updated_at == "2024-01-02T03:04:05.000060+00:00"
    assert first.scraped_at is None and list(first.asDict()) == LISTING.names


def test_response_fields(spark):
    row = listings(spark, {"price": 5}).select(project_response().alias("l")).first().l.asDict()
    assert len(row) == 21 and row["price"] == 5


def test_display(spark):
    df = spark.createDataFrame([(90210, 9.0, 45, True, 0.98765), (None, 3.5, 0, None, 0.5)], "p int, r double, s int, f boolean, x double")
    shown = df.select(
        D.format_price(F.col("p")), D.format_rooms(F.col("r")), D.format_size(F.col("s")), D.format_flag(F.col("f")),
        D.score_percent(F.col("x")), D.score_percent(F.col("x"), 1),
    ).collect()
    assert tuple(shown[0]) == ("₪90,210", "9", "45 מ²", "כן", "98.77%", "98.8%")
    assert tuple(shown[1]) == ("לא צוין", "3.5", "לא צוין", "לא צוין", "50.00%", "50.0%")


def test_display_lines(spark):
    df = listings(spark, {"city": "c", "location": "", "neighborhood": "n", "floor": 0, "has_parking": True, "pets_allowed": True})
    assert tuple(df.select(D.place_line(), D.floor_line(), D.feature_line()).first()) == ("c, n", "קומה 0", "🚗 חניה | 🐾 חיות מחמד")
