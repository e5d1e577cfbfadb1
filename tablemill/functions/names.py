"""Choices made from column names alone. They run on the driver over the schema."""

from __future__ import annotations

import re

# Columns that carry links, time stamps, tags or contributor data.
REDUNDANT_COLUMNS = """
image_url image_small_url image_front_url image_front_small_url image_front_thumb_url image_thumb_url
image_nutrition_url image_nutrition_small_url image_ingredients_url image_ingredients_small_url
created_datetime last_modified_datetime last_modified_t created_t last_image_t last_image_datetime
creator last_modified_by editors editors_tags
url packaging_tags misc_tags origins_tags traces_tags packaging_text packaging brands_tags categories_tags
labels_tags labels_en labels_fr labels countries_tags countries_en countries states_tags states_en states
emb_codes_tags emb_codes cities_tags purchase_places stores stores_tags
complete checked rev entry_dates_tags additives_n additives_tags additives unknown_nutrients_tags
correctors_tags photographers_tags informers_tags checkers_tags
generic_name serving_size nutrition_grade_fr main_category image_nutrition_thumb_url
""".split()

# Name parts of nutrition columns.
NUTRITION_PARTS = ["energy", "fat", "protein", "carbohydrates", "sugar", "fiber", "salt"]

# Name parts of columns that come first in a numeric table.
PRIORITY_PARTS = ["_100g", "score", "quantity", "energy", "fat", "protein", "carbohydrate", "sugar",
                  "fiber", "salt"]

# Name patterns of columns a sample must not be stratified on.
SAMPLING_EXCLUDED = ["_t$", "_datetime$", "url", "code", "creator", "created", "modified", "updated",
                     "id", "uuid", "guid", "hash", "key", "index", "timestamp", "date", "time", "version"]

# Name parts of columns that are not worth encoding.
ENCODING_EXCLUDED = ["url", "datetime", "date", "time", "image"]
ENCODING_EXCLUDED_ENDINGS = ["_tags", "_en"]

IDENTIFIER_COLUMNS = ["code", "id", "Unnamed: 0"]


def nutrition_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if any(part in c for part in NUTRITION_PARTS)]


def priority_order(columns: list[str]) -> list[str]:
    """Stable order, names with a priority part first."""
    return sorted(columns, key=lambda c: not any(part in c.lower() for part in PRIORITY_PARTS))


def redundant_columns(columns: list[str]) -> list[str]:
    return [c for c in REDUNDANT_COLUMNS if c in columns]


def excluded_from_sampling(column: str) -> bool:
    """Patterns ending in ``$`` are anchored, the others match anywhere in the name."""
    return any(re.search(pattern, column.lower()) for pattern in SAMPLING_EXCLUDED)


def excluded_from_encoding(column: str) -> bool:
    name = column.lower()
    return any(part in name for part in ENCODING_EXCLUDED) or any(
        column.endswith(end) for end in ENCODING_EXCLUDED_ENDINGS
    )


def clustering_candidates(columns: list[str], default: int = 5) -> tuple[list[str], list[str]]:
    """Columns offered for clustering and the ones chosen when the caller names none."""
    offered = [c for c in columns if c not in IDENTIFIER_COLUMNS]
    return offered, offered[:default]
