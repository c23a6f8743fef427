"""Fixed values.

Everything here is data that results depend on: scale limits, labels and
sentences. They are stated literally; the rules using them live in
``skysift.functions``.
"""

# --- fixed values: PM2.5 scale (lo_pm, hi_pm, lo_aqi, hi_aqi), both ends inclusive
BREAKPOINTS = [
    (0.0, 12.0, 0, 50),
    (12.0, 35.4, 51, 100),
    (35.4, 55.4, 101, 150),
    (55.4, 150.4, 151, 200),
    (150.4, 250.4, 201, 300),
    (250.4, 350.4, 301, 400),
    (350.4, 500.4, 401, 500),
]
AQI_CEILING = 500.0

# --- fixed values: tiers (upper limit, label, css class, health advisory)
CATEGORIES = [
    (50, "Good", "good", "Air quality is satisfactory. Enjoy outdoor activities!"),
    (100, "Moderate", "moderate", "Sensitive individuals should consider reducing prolonged outdoor exertion."),
    (150, "Unhealthy for Sensitive", "sensitive", "Children and people with respiratory diseases should limit outdoor exertion."),
    (200, "Unhealthy", "unhealthy", "Everyone may experience health effects. Wear a mask outdoors."),
    (300, "Very Unhealthy", "very-unhealthy", "Health warnings of emergency conditions. Avoid outdoor activities."),
    (999, "Hazardous", "hazardous", "Health alert: stay indoors, keep windows closed, use air purifiers."),
]

# --- fixed values: trend arrows
UP, DOWN, FLAT = "↑", "↓", "→"

# --- fixed values: advice per severity
ADVICE = {
    "good": "Great day for outdoor activities.",
    "moderate": "Sensitive individuals should consider reducing prolonged outdoor exertion.",
    "sensitive": "Children and people with respiratory diseases should limit outdoor exertion.",
    "unhealthy": "Limit outdoor exposure. Wear a mask if going outside.",
    "very-unhealthy": "Avoid outdoor activities. Keep windows closed.",
    "hazardous": "Stay indoors. Use air purifiers. Health emergency conditions.",
}
ADVICE_DEFAULT = "Monitor conditions."

# --- fixed values: message titles (severity, trend, title)
TITLES = [
    ("good", UP, "Air quality is good but showing early signs of change"),
    ("good", DOWN, "Air quality is excellent and improving"),
    ("good", FLAT, "Air quality is excellent and stable"),
    ("moderate", UP, "Air quality declining toward unhealthy levels"),
    ("moderate", DOWN, "Air quality improving from moderate levels"),
    ("moderate", FLAT, "Air quality is moderate and holding steady"),
    ("sensitive", UP, "Air quality is unhealthy for sensitive groups and worsening"),
    ("sensitive", DOWN, "Air quality improving but still affects sensitive groups"),
    ("sensitive", FLAT, "Air quality remains a concern for sensitive groups"),
    ("unhealthy", UP, "Air quality is unhealthy and worsening"),
    ("unhealthy", DOWN, "Air quality is beginning to recover from unhealthy levels"),
    ("unhealthy", FLAT, "Air quality remains unhealthy with no improvement"),
    ("very-unhealthy", UP, "Dangerous air quality and still rising"),
    ("very-unhealthy", DOWN, "Very unhealthy air but showing signs of recovery"),
    ("very-unhealthy", FLAT, "Very unhealthy air quality persisting"),
    ("hazardous", UP, "EMERGENCY: Hazardous air quality and worsening"),
    ("hazardous", DOWN, "Hazardous conditions easing slightly"),
    ("hazardous", FLAT, "EMERGENCY: Hazardous air quality persisting"),
]

# --- fixed values: insight sentences
INSIGHT = {
    "baseline": "Establishing baseline data pattern...",
    "critical": "Critically high pollution levels detected in this area.",
    "variable": "High variability in air quality detected. Conditions are changing rapidly.",
    "rising_high": "Pollution levels are increasing steadily. Expect worsening conditions.",
    "falling_high": "Air quality is beginning to improve, but remains elevated.",
    "flat_good": "Air quality is stable and excellent for outdoor activities.",
    "flat": "Stable air quality patterns observed.",
    "rising": "Noticeable upward trend in particulate matter.",
    "falling": "Slight downward drift in pollution detected.",
}

# --- fixed values: alert sentences
ALERT_SPIKE = "⚠️ Rapid Pollution Spike!"
ALERT_LEVELS = [
    (300, "🚨 EMERGENCY: Hazardous Air Quality"),
    (200, "🔴 Very Unhealthy Air Quality"),
    (150, "🔴 Unhealthy Air Quality"),
    (100, "🟠 Sensitive Groups at Risk"),
]

# --- fixed values: outlook sentences, in the order in which they are tried
OUTLOOK = {
    "much_worse": "Expected to worsen significantly in the next hour.",
    "worse": "Expected to rise further in the next hour.",
    "much_better": "Expected to improve significantly in the next hour.",
    "better": "Expected to improve in the next hour.",
    "same": "Expected to remain around current levels.",
}
TREND_WORDS = {UP: "upward", DOWN: "downward", FLAT: "stable"}
TREND_VERBS = {UP: "worsening", DOWN: "improving", FLAT: "unchanged"}
TRAFFIC_SENTENCE = " Likely influenced by heavy traffic conditions."

# --- fixed values: display
PRIORITY_BADGES = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🟢"}
BADGE_DEFAULT = "⚪"
MISSING = "—"
NO_ALERT = "No active alerts"
ALERT_FALLBACK = "Alert active"
INSIGHT_FALLBACK = "Waiting for data…"
ALERTING = ["unhealthy", "very-unhealthy", "hazardous"]

# --- fixed values: source tags
SOURCE_PROVIDER = "OpenWeatherMap"
SOURCE_FILLED = "Interpolated"

# --- fixed values: stream and history sizes
TOPIC_RAW = "raw-aqi"
TOPIC_ENRICHED = "processed-aqi"
WINDOW_SECONDS = 300
WATERMARK_SECONDS = 600
TRIGGER_SECONDS = 10
POLL_SECONDS = 60
FILL_SECONDS = 10
HISTORY_ROWS = 30
HISTORY_SHOWN = 20
FEATURE_ROWS = 12
HORIZON_STEPS = 12
MAX_ACTIVE = 8

# --- fixed values: default active places
DEFAULT_ACTIVE = ["Delhi", "Mumbai", "Beijing", "London", "New York", "Shanghai", "Tokyo", "Sydney"]

# --- fixed values: place catalog (name, lat, lon, region)
CATALOG = [
    ("Delhi", 28.6139, 77.2090, "Asia"),
    ("Mumbai", 19.0760, 72.8777, "Asia"),
    ("Chennai", 13.0827, 80.2707, "Asia"),
    ("Kolkata", 22.5726, 88.3639, "Asia"),
    ("Bangalore", 12.9716, 77.5946, "Asia"),
    ("Hyderabad", 17.3850, 78.4867, "Asia"),
    ("Beijing", 39.9042, 116.4074, "Asia"),
    ("Shanghai", 31.2304, 121.4737, "Asia"),
    ("Tokyo", 35.6895, 139.6917, "Asia"),
    ("Seoul", 37.5665, 126.9780, "Asia"),
    ("Bangkok", 13.7563, 100.5018, "Asia"),
    ("Jakarta", -6.2088, 106.8456, "Asia"),
    ("Singapore", 1.3521, 103.8198, "Asia"),
    ("Dhaka", 23.8103, 90.4125, "Asia"),
    ("Karachi", 24.8607, 67.0011, "Asia"),
    ("Hanoi", 21.0285, 105.8542, "Asia"),
    ("Dubai", 25.2048, 55.2708, "Asia"),
    ("London", 51.5074, -0.1278, "Europe"),
    ("Paris", 48.8566, 2.3522, "Europe"),
    ("Berlin", 52.5200, 13.4050, "Europe"),
    ("Madrid", 40.4168, -3.7038, "Europe"),
    ("Rome", 41.9028, 12.4964, "Europe"),
    ("Moscow", 55.7558, 37.6173, "Europe"),
    ("Istanbul", 41.0082, 28.9784, "Europe"),
    ("Warsaw", 52.2297, 21.0122, "Europe"),
    ("Amsterdam", 52.3676, 4.9041, "Europe"),
    ("New York", 40.7128, -74.0060, "Americas"),
    ("Los Angeles", 34.0522, -118.2437, "Americas"),
    ("Chicago", 41.8781, -87.6298, "Americas"),
    ("Houston", 29.7604, -95.3698, "Americas"),
    ("Mexico City", 19.4326, -99.1332, "Americas"),
    ("São Paulo", -23.5505, -46.6333, "Americas"),
    ("Buenos Aires", -34.6037, -58.3816, "Americas"),
    ("Lima", -12.0464, -77.0428, "Americas"),
    ("Bogota", 4.7110, -74.0721, "Americas"),
    ("Toronto", 43.6532, -79.3832, "Americas"),
    ("Cairo", 30.0444, 31.2357, "Africa"),
    ("Lagos", 6.5244, 3.3792, "Africa"),
    ("Nairobi", -1.2921, 36.8219, "Africa"),
    ("Johannesburg", -26.2041, 28.0473, "Africa"),
    ("Casablanca", 33.5731, -7.5898, "Africa"),
    ("Sydney", -33.8688, 151.2093, "Oceania"),
    ("Melbourne", -37.8136, 144.9631, "Oceania"),
    ("Auckland", -36.8485, 174.7633, "Oceania"),
]
