"""Demand and supply by destination and category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Demand index and bookable supply of each destination and category, and of those not listed.
DEMAND = {
    "split": {"boat_tour": (100, 74), "day_trip": (78, 41), "food_drink": (61, 14), "water_sports": (54, 26), "walking_tour": (48, 33), "adventure": (44, 19), "cultural": (39, 27), "private_guide": (31, 9), "transfer": (29, 22)},
    "dubrovnik": {"walking_tour": (92, 68), "boat_tour": (84, 55), "day_trip": (71, 44), "cultural": (66, 51), "food_drink": (52, 11), "water_sports": (41, 18), "private_guide": (37, 12), "adventure": (24, 13)},
    "hvar": {"boat_tour": (88, 47), "water_sports": (46, 15), "food_drink": (43, 8), "day_trip": (38, 21), "walking_tour": (22, 12)},
    "zadar": {"day_trip": (64, 30), "boat_tour": (57, 28), "adventure": (49, 16), "food_drink": (36, 7), "walking_tour": (33, 19)},
    "sibenik": {"day_trip": (58, 24), "adventure": (47, 13), "boat_tour": (42, 20), "cultural": (29, 17)},
    "rovinj": {"food_drink": (69, 16), "walking_tour": (44, 26), "boat_tour": (41, 23), "cultural": (35, 21)},
    "pula": {"cultural": (63, 39), "day_trip": (45, 22), "food_drink": (42, 10), "adventure": (31, 14)},
    "zagreb": {"walking_tour": (71, 52), "food_drink": (66, 19), "cultural": (58, 40), "day_trip": (51, 33)},
    "korcula": {"food_drink": (54, 9), "boat_tour": (47, 24), "water_sports": (28, 11)},
    "omis": {"adventure": (76, 31), "water_sports": (52, 20), "boat_tour": (34, 18)},
    "trogir": {"boat_tour": (49, 27), "walking_tour": (27, 16)},
    "makarska": {"water_sports": (45, 19), "adventure": (38, 15), "boat_tour": (36, 21)},
}
DEFAULT_DEMAND, DEFAULT_SUPPLY = 25, 9
SCALE_MAX, EQUILIBRIUM = 100, 0.6
#: Search terms and the categories they stand for.
QUERY_CATEGORIES = {
    "boat tour": "boat_tour", "sailing charter": "boat_tour", "excursion": "day_trip", "day trip": "day_trip", "tour operator": "day_trip", "travel agency": "day_trip",
    "kayak tour": "water_sports", "sea kayaking": "water_sports", "diving centre": "water_sports", "rafting": "adventure", "quad safari": "adventure", "zipline": "adventure",
    "wine tasting tour": "food_drink", "wine tasting": "food_drink", "food tour": "food_drink", "truffle hunting": "food_drink", "walking tour": "walking_tour",
    "free walking tour": "walking_tour", "private guide": "private_guide", "things to do": "other",
}


def demand_table(spark: SparkSession, demand: dict[str, dict[str, tuple[int, int]]] = DEMAND) -> DataFrame:
    """(destination, category, demand, supply), one row per listed cell."""
    rows = [(d, c, *cell) for d, cells in demand.items() for c, cell in cells.items()]
    return spark.createDataFrame(rows, "destination string, category string, demand int, supply int")
