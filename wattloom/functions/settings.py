"""Fixed values. They must equal the source system's for results to agree."""

# tariffs and emissions
TARIFF_VND = 3100.0
TARIFF_USD = 0.125
KG_CO2_PER_KWH = 0.6766

# defaults for absent data
DEFAULT_TEMPERATURE_C = 26.0
DEFAULT_LOAD_KWH = 200.0
DEFAULT_INTERVAL_S = 3600.0

# feature order of the two models
LOAD_FEATURES = [
    "air_temperature", "hour", "dayofweek", "is_weekend",
    "hour_sin", "hour_cos", "lag_1h", "lag_24h",
]
DETECTOR_FEATURES = ["meter_reading"] + LOAD_FEATURES
QUANTILES = [0.025, 0.5, 0.975]

# column aliases, first present wins
READING_ALIASES = ["meter_reading_kwh", "reading", "load_kwh"]
TEMPERATURE_ALIASES = ["airTemperature", "air_temp", "outdoor_temperature_c", "temp"]
USE_ALIASES = ["primaryspaceusage", "primary_use", "primary_space_usage"]
WEATHER_ALIASES = ["airTemperature", "air_temperature", "air_temp"]

# share of a building's load by zone
ZONE_SHARES = {
    "z1": 0.08, "z2": 0.12, "z3": 0.09, "z4": 0.11, "z5": 0.10,
    "z6": 0.14, "z7": 0.07, "z8": 0.13, "z9": 0.06, "z10": 0.10,
}
UNKNOWN_ZONE_SHARE = 0.10

# monitoring thresholds
KS_PVALUE_LIMIT = 0.05
PSI_LIMIT = 0.2
MAPE_LIMIT = 15.0
PSI_BINS = 10
PSI_EPSILON = 1e-4
ROLLING_ROWS = 168

STATUSES = ["OPEN", "ACKNOWLEDGED", "RESOLVED", "IGNORED"]

# status words of the floor plan
NO_READING_LABEL = "Chưa có đo"
TEMPERATURE_LABELS = ["Mát lạnh", "Tối ưu", "Hơi ấm", "Nhiệt cao"]
LOAD_LABELS = ["Tiết kiệm", "Trung bình", "Lãng phí cao"]

# advice by severity; %s is the reading with one decimal
ADVICE = {
    "HIGH": "Khẩn cấp (%s kWh): Phụ tải tăng vọt bất thường. "
            "Kiểm tra ngay cụm chiller/HVAC trung tâm, van bypass hoặc sự cố kẹt rơ-le công suất.",
    "MEDIUM": "Cảnh báo (%s kWh): Tải tiêu thụ lệch chuẩn ngoài giờ. "
              "Kiểm tra hệ thống chiếu sáng khu vực, quạt thông gió FCU hoặc thiết bị chưa tắt sau ca làm việc.",
    "LOW": "Lưu ý (%s kWh): Dao động phụ tải nhẹ bất thường so với nền nhiệt độ. "
           "Tiếp tục theo dõi các chu kỳ kế tiếp để xác nhận xu hướng.",
}

# incident texts
REPLAY_KEY = "replay-v1|%s|%s|%s|%s"
REPLAY_SUBSYSTEM = "Chiller & HVAC Plant"
REPLAY_REASON = "Abnormal load deviation exceeding baseline prediction"
REPLAY_ACTION = "Inspect chiller plant schedule and sub-meter power draw."
ZONE_TITLE = "Khu vực "
BUILDING_TITLE = "Tổng tòa nhà"

# header of the daily report file
DAILY_HEADER = ["Ngày", "Điện năng (kWh)", "Công suất đỉnh (kW)", "Số bản ghi"]
NO_COOLING_NOTE = "Cửa sổ dự báo không có giờ làm mát (07:00–18:00 giờ Việt Nam) nên tiết kiệm bằng 0."

# intent words, first list that matches wins
INTENT_WORDS = {
    "fault_diagnostics": ["bất thường", "sự cố", "anomaly", "chẩn đoán", "nguyên nhân", "lỗi"],
    "load_forecasting": ["dự báo", "forecast", "ngày mai", "đỉnh", "peak"],
    "metrics_overview": ["tổng quan", "tiêu thụ", "kwh", "chỉ số", "metrics"],
    "cost_estimation": ["chi phí", "tiền", "lãng phí", "cost"],
}
OTHER_INTENT = "general_query"

# follow-up questions and conditional questions
FOLLOW_UP_PHRASES = [
    "còn nguyên nhân nào", "nguyên nhân khác", "tại sao", "khắc phục thế nào",
    "làm gì để khắc phục", "chi tiết hơn", "giải thích thêm", "nữa không",
]
FOLLOW_UP_WORDS = ["nào", "sao", "thế"]
CONDITION_CUES = ["nếu", "giả sử", "what if"]
SETPOINT_PATTERN = (
    r"(?:setpoint|nhiệt độ đặt|điều hoà|điều hòa|máy lạnh)\D{0,25}?(\d+(?:[.,]\d+)?)\s*(?:độ|°)"
)
EARLY_OFF_PATTERN = (
    r"(?:chiller|hvac|điều hoà|điều hòa|máy lạnh)\D{0,25}?sớm(?: hơn)?\D{0,10}?(\d+)\s*(?:giờ|tiếng|h\b)"
)
HOUSE_SOURCE = "Tài liệu nội bộ"
PASSAGE_PREFIX = "passage: "
