"""Column names, schemas and the fixed label values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names of the logical transaction table.
# ---------------------------------------------------------------------------
TX_ID = "Transaction_ID"
USER_ID = "User_ID"
AMOUNT = "Amount_VND"
TS = "Timestamp"
PAYMENT = "Payment_Method"
CATEGORY = "Merchant_Category"
LOCATION = "Location"
FRAUD = "Is_Fraud"
HOUR = "Hour"
WEEKEND = "Is_Weekend"
RISK = "Risk_Score"

RAW_COLUMNS = [TX_ID, USER_ID, AMOUNT, TS, PAYMENT, CATEGORY, LOCATION, FRAUD, HOUR, WEEKEND]

# Raw CSV text: every column is read as a string and parsed explicitly.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

DEFAULT_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Sums go through an exact decimal so they do not depend on partition order.
MONEY = T.DecimalType(28, 6)

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the reference's values for equal results.
# ---------------------------------------------------------------------------

# Merchant-category localisation (unknown values pass through unchanged).
CATEGORY_LABELS = {
    "Transport": "Giao thông & Di chuyển",
    "Utilities": "Điện nước & Tiện ích",
    "Supermarket": "Siêu thị",
    "Shopping": "Mua sắm",
    "Food & Beverage": "Ăn uống",
}

# Payment localisation (only this one value is translated).
PAYMENT_LABELS = {"E-Wallet": "Ví điện tử"}

# Weekday labels, Monday first (weekday number 0 = Monday).
WEEKDAY_LABELS = ["Thứ Hai", "Thứ Ba", "Thứ Tư", "Thứ Năm", "Thứ Sáu", "Thứ Bảy", "Chủ Nhật"]

# Segment names given to clusters in ascending order of mean Monetary;
# any extra cluster takes the last name.
SEGMENT_NAMES = [
    "Người dùng mới/Ít hoạt động",
    "Khách hàng phổ thông",
    "Khách hàng tiềm năng",
    "Khách hàng VIP",
]

# Funnel step labels (the steps use >=, so the labels say so).
FUNNEL_LABELS = ["Tất cả người dùng", "Người dùng ≥ 2 GD", "Người dùng ≥ 5 GD (Trung thành)"]

# Rule-based insight texts.
INSIGHT_NO_DATA = "Không có dữ liệu cho bộ lọc hiện tại."
INSIGHT_WEEKEND = "Người dùng có xu hướng chi tiêu mạnh vào cuối tuần."
INSIGHT_PEAK_HOUR = "Khung giờ hoạt động cao nhất là %d:00 - %d:00."

# Province lookup: name -> (lat, lon), used to place map bubbles.
PROVINCE_COORDS = [
    ("Hà Nội", 21.0285, 105.8542),
    ("Hồ Chí Minh", 10.8231, 106.6297),
    ("TP.HCM", 10.8231, 106.6297),
    ("Đà Nẵng", 16.0544, 108.2022),
    ("Cần Thơ", 10.0452, 105.7469),
    ("Hải Phòng", 20.8449, 106.6881),
    ("Bình Dương", 10.9804, 106.6519),
    ("Đồng Nai", 10.9575, 106.8427),
    ("Khánh Hòa", 12.2462, 109.1944),
    ("Quảng Ninh", 20.9599, 107.0445),
]
# Province-name prefixes stripped before matching, and the one alias pair.
PROVINCE_PREFIXES = ["Thành phố ", "Tỉnh "]
PROVINCE_ALIASES = {"Hồ Chí Minh": "TP.HCM", "TP.HCM": "Hồ Chí Minh"}

# Map drawing constants: bubble radius floor and scale; choropleth cut points.
BUBBLE_MIN_RADIUS = 5.0
BUBBLE_SCALE = 25.0
CHOROPLETH_CUTS = [0.8, 0.5, 0.2]

# Sort columns accepted by the transaction listing; anything else -> Timestamp.
SORTABLE_COLUMNS = [TS, AMOUNT, USER_ID, PAYMENT, CATEGORY, LOCATION]

# Tokens the reference's CSV reader turns into missing values (pandas defaults).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Fraud model: features, categorical inputs, defaults for missing inputs.
FRAUD_CATEGORICAL = [PAYMENT, CATEGORY, LOCATION]
FRAUD_NUMERIC = [AMOUNT, HOUR, WEEKEND]
FRAUD_INPUT_DEFAULTS = {
    AMOUNT: 0.0,
    HOUR: 12,
    WEEKEND: 0,
    PAYMENT: "Ví điện tử",
    CATEGORY: "Ăn uống",
    LOCATION: "Hà Nội",
}
TREE_MAX_DEPTH = 4
FOREST_TREES = 50
TEST_PERCENT = 20
MODEL_SEED = 42

# Decision-rule wording.
FIELD_LABELS = {
    PAYMENT: "Hình thức thanh toán",
    CATEGORY: "Danh mục ngành hàng",
    LOCATION: "Tỉnh/Thành phố",
}
RULE_PAID_WITH = "Thanh toán bằng %s"
RULE_FIELD_IS = "%s: %s"
RULE_FIELD_IS_NOT = "%s: không phải %s"
RULE_NOT_PAID_WITH = "Không thanh toán bằng %s"
RULE_AMOUNT = "Số tiền giao dịch %s %s đ"
RULE_HOUR = "Giờ giao dịch %s %dh"
RULE_WEEKDAY = "Giao dịch trong tuần"
RULE_WEEKEND = "Giao dịch vào cuối tuần"

# Verdict texts for scored rows.
VERDICT_FRAUD = "PHÁT HIỆN GIAN LẬN"
VERDICT_SAFE = "GIAO DỊCH AN TOÀN"

# Model comparison.
MODEL_NAMES = {"decision_tree": "Decision Tree", "random_forest": "Random Forest"}
COMPARE_TIE = "Tương đương"
COMPARE_TIE_POINTS = 0.1

# Customer segmentation.
KMEANS_K = 4
KMEANS_RESTARTS = 10

# Headline "growth" tile: max(1, 8 - fraud_rate / 2), or 8.2 when no fraud.
GROWTH_BASE = 8.0
GROWTH_FLOOR = 1.0
GROWTH_NO_FRAUD = 8.2

# Payment -> category flows below this share of the total are dropped.
FLOW_MIN_SHARE = 0.005


@dataclass(frozen=True)
class FilterParams:
    """Optional equality filters; ``None`` or ``""`` means "no filter"."""

    location: str | None = None
    payment_method: str | None = None
    merchant_category: str | None = None
