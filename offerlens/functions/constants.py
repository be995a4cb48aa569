"""Names, weights, bins and texts that results must agree on."""

from __future__ import annotations

DAY_US = 86_400_000_000
WEEK_DAYS = 7

# The model-facing columns of a pair, in this order.
PAIR_FEATURES = [
    "age", "sex_code", "user_pref_code", "item_pref_code", "pref_match", "genre_code", "capsule_code", "price_rate",
    "log_catalog_price", "log_discount_price", "log_user_mean_price", "price_distance", "log_user_purchases",
    "log_user_visits", "days_since_purchase", "log_user_genre_purchases", "log_user_genre_visits",
    "log_item_purchases", "log_item_visits", "log_genre_purchases", "log_same_item_purchases",
]
PAIR_CATEGORICAL = ["sex_code", "user_pref_code", "item_pref_code", "genre_code", "capsule_code"]

# Weights of the rule score.
RULE_WEIGHTS = {
    "pref_match": 1.1,
    "log_user_genre_purchases": 0.9,
    "log_user_genre_visits": 0.25,
    "log_genre_purchases": 0.28,
    "log_item_purchases": 0.18,
    "log_item_visits": 0.08,
    "price_rate": 0.012,
    "price_distance": -0.08,
}
# Weight of genre popularity beside item popularity; weights of the preference baseline.
POPULARITY_GENRE_WEIGHT = 0.2
PREFERENCE_GENRE_VIEW_WEIGHT = 0.5
PREFERENCE_REGION_WEIGHT = 0.25
DAYS_WITHOUT_PURCHASE = 365.0

# Right-closed bins.
AGE_BINS = [(19, "<20"), (29, "20-29"), (39, "30-39"), (49, "40-49"), (59, "50-59")]
AGE_TOP = "60+"
PRICE_BAND_EDGES = [5.5, 6.5, 7.5, 8.5]

# Markers for missing categories and the tags of sampled rows.
MISSING = "__MISSING__"
MISSING_GENRE = "__MISSING_GENRE__"
MISSING_PREF = "__MISSING_PREF__"
NO_REGION = "__NONE__"
SOURCE_POSITIVE = "positive"
SOURCE_GENRE = "L1_same_genre_similar"
SOURCE_BAND = "L2_similar_price_band"
SOURCE_RANDOM = "L3_random_fallback"

# Sampling sizes.
NEGATIVES_PER_USER_WEEK = 8
NEGATIVES_PER_EVENT = 5
POPULAR_CANDIDATES = 100
MAX_CANDIDATES_PER_USER = 500
MIN_ITEMS_PER_GENRE = 20
BOOTSTRAP_REPEATS = 2000
TOP_K = 10
MAX_REQUEST_TOP_K = 20

# Reason texts of a recommendation and the version names of the two methods.
REASON_REGION = "地区匹配"
REASON_BOUGHT_GENRE = "历史购买偏好匹配"
REASON_VIEWED_GENRE = "历史浏览偏好匹配"
REASON_GENERIC = "基于优惠信息与总体偏好排序"

# Categorical columns of the event-time frame and the columns a model must not see.
EVENT_CATEGORICAL = [
    "sex_id", "user_pref_name", "age_bucket", "genre_name", "capsule_text", "large_area_name", "item_pref_name",
    "small_area_name",
]
NON_FEATURES = {
    "user_id", "item_id", "label", "positive_event_id", "reference_item_id", "negative_source", "disp_from",
    "item_split", "first_purchase", "last_purchase", "purchase_price_sum", "discount_rate_sum",
    "user_item_purchase_count", "feature_event_time", "history_last_purchase_time", "state_time", "disp_year",
    "disp_month", "disp_day",
}
# Features that one event's positive and negatives share.
SHARED_HISTORY = [
    "user_purchase_count", "user_avg_purchase_price", "user_avg_discount_rate", "user_view_count",
    "user_active_days", "view_to_purchase_ratio",
]

# Which dictionary translates which column of which table.
TRANSLATION_FIELDS = {
    "items": {"capsule_text": "capsule", "genre_name": "genre", "pref_name": "pref",
              "small_area_name": "small_area", "large_area_name": "large_area"},
    "target_items": {"capsule_text": "capsule", "genre_name": "genre", "pref_name": "pref",
                     "small_area_name": "small_area", "large_area_name": "large_area"},
    "purchases": {"small_area_name": "small_area"},
    "users": {"pref_name": "pref"},
}

# Item columns that a model may see.
ITEM_FEATURES = [
    "item_id", "genre_name", "capsule_text", "price_rate", "catalog_price", "discount_price", "disp_period",
    "valid_period", "large_area_name", "pref_name", "small_area_name", "disp_from", "discount_amount",
    "discount_ratio", "log_catalog_price", "log_discount_price", "display_days", "disp_year", "disp_month",
    "disp_weekday", "disp_day",
]
