"""Parameters the analyses are defined with."""

# Inactivity windows compared for churn labels, and the reference window, in days.
CHURN_WINDOWS = (30, 40, 45, 50, 60)
CHURN_WINDOW = 45

# Grid of the gap distribution and its reported days.
MAX_GAP_DAY = 120
KEY_DAYS = (15, 30, 40, 45, 50, 60, 90)
GAP_PERCENTILES = (50, 70, 80, 85, 90, 92, 95, 96, 97, 98, 99)

# Conversion label: days a single-invoice customer must have been observed.
CONVERSION_WINDOW = 90
CONVERSION_WINDOWS = (45, 60, 90, 120)

# Outlier rules.
CAP_QUANTILE = 0.999
IQR_FACTOR = 1.5

# Country groups for the first-invoice features.
HOME_COUNTRY = "United Kingdom"
COUNTRY_GROUPS = {
    "Europe_Major": (
        "Germany", "France", "Netherlands", "Spain", "Belgium", "Switzerland", "Portugal",
        "Italy", "Austria", "Sweden", "Norway", "Denmark", "Finland",
    ),
    "Europe_Other": ("EIRE", "Channel Islands", "Iceland"),
}

# Description patterns for the first-invoice features.
PRODUCT_PATTERNS = {
    "has_christmas": "CHRISTMAS|XMAS|NOEL",
    "has_gift": "GIFT|PRESENT|WRAP",
    "has_vintage": "VINTAGE|RETRO",
    "has_heart": "HEART|LOVE",
}

# Feature lists.
CHURN_FEATURES = (
    "recency", "T", "frequency", "total_spend", "avg_spend", "avg_basket",
    "unique_products", "avg_gap", "std_gap", "last_gap", "recency_ratio",
)
CLV_FEATURES = (
    "recency", "T", "frequency", "total_spend",
    "avg_spend_per_transaction", "avg_basket_size", "avg_items_per_visit",
    "unique_products", "num_countries",
    "freq_last_3m", "monetary_last_3m", "qty_last_3m",
    "freq_months_3_to_6", "monetary_months_3_to_6", "qty_months_3_to_6",
    "freq_last_6m", "monetary_last_6m",
    "avg_gap", "std_gap", "last_gap",
    "monetary_trend", "freq_trend", "gap_acceleration",
    "recency_ratio", "is_one_timer",
)
SURVIVAL_FEATURES = (
    "num_transactions", "total_spend_log", "avg_spend_log", "std_spend",
    "avg_basket_size", "avg_items_per_visit", "avg_gap", "std_gap", "last_gap",
    "monetary_trend", "gap_acceleration", "recency_ratio",
)
CLUSTER_FEATURES = ("frequency", "recency", "monetary_value", "T")

# Right-closed bins and their labels; the last bin has no upper edge.
OPEN = float("inf")
FREQUENCY_BINS = ((-1, 0, 2, 10, OPEN),
                  ("One-Timer (f=0)", "Low Freq (1-2)", "Medium Freq (3-10)", "High Freq (10+)"))
RECENCY_BINS = ((-1, 30, 90, 180, OPEN),
                ("Recent (<30d)", "Active (30-90d)", "Lapsing (90-180d)", "Dormant (>180d)"))
CV_BINS = ((-0.01, 0.3, 0.7, 1.5, OPEN),
           ("Low CV (<0.3)", "Med CV (0.3-0.7)", "High CV (0.7-1.5)", "Very High CV (>1.5)"))
RISK_BINS = ((-0.01, 0.3, 0.7, 1.01), ("High Risk", "Medium Risk", "Low Risk"))
BUCKET_BINS = ((-1, 0, 2, 5, 10, 20, OPEN), ("0", "1-2", "3-5", "6-10", "11-20", "20+"))

# Scorecard and survival horizons in days, and status wording.
HORIZONS = (30, 90, 180, 360)
KM_TIME_POINTS = (30, 90, 180, 365, 540, 730)
EVAL_GRID = (30, 700, 30)
STATUS = {1: "Churned", 0: "Active/Censored"}
WINBACK = "Churned - Loss/Winback"
TIERS = ("Gold", "Silver", "Bronze")
ONE_TIMER = "One-Timer"
