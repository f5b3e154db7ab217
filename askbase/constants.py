"""Fixed values that must equal the reference's for right results.

They are stated once here, in natural order, as plain text.
"""

# --- fixed values: keyword phrases per route (rule order = priority) ---
MEAL_PHRASES_WEB = ["yemekte ne var", "bugün yemekte ne var", "bugünkü yemekler neler", "bugün menüde ne var"]
MEAL_PHRASES_LOCAL = ["yemekte ne var", "bugün yemekte ne var", "bugünkü yemekler neler", "bugün menüde ne var", "yemek", "menü"]
DATE_PHRASES = ["tarih", "bugünün tarihi", "bugün hangi gün"]
TIME_PHRASES = ["saat kaç", "saat nedir", "saat"]
WEEKDAY_PHRASES = ["bugün günlerden ne", "bugün günlerden neyse"]
TOMORROW_PHRASES = ["yarın ayın kaçı", "yarın hangi gün", "yarın günlerden ne"]

# --- fixed values: match thresholds (token-sort ratio, compared with >=) ---
THRESHOLD_WEB = 55
THRESHOLD_LOCAL = 50

# --- fixed values: Turkish month names, January to December ---
MONTH_NAMES_TR = ["Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz",
                  "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık"]

# --- fixed values: English weekday name -> Turkish weekday name ---
DAY_NAMES_TR = {
    "Monday": "Pazartesi",
    "Tuesday": "Salı",
    "Wednesday": "Çarşamba",
    "Thursday": "Perşembe",
    "Friday": "Cuma",
    "Saturday": "Cumartesi",
    "Sunday": "Pazar",
}

# English weekday names in day-of-week order (1 = Sunday), as strftime('%A') spells them.
WEEKDAYS_FROM_SUNDAY = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]

# --- fixed values: sentences ---
FALLBACK_ANSWER = "Bu sorunuzu yanıtlayamıyorum, en kısa sürede yanıtlayacağım."
MENU_UNAVAILABLE = "Günün yemeği bilgisine ulaşılamıyor."
BOT_ERROR_MESSAGE = "Bir hata oluştu, lütfen daha sonra tekrar deneyiniz."

# --- fixed values: curation export and training ---
EXPORT_TAG = "custom_tag"
IGNORE_TOKENS = ["?", "!", ",", "."]
SPLIT_SEED = 123
TEST_FRACTION = 0.25
MAX_LEN_TRAIN = 256
MAX_LEN_SERVE = 512
EVAL_EVERY_STEPS = 50
MENU_CONTAINER = ("table", "has-background")
ECHO_PATTERN = "/echo (.+)"

# Route names used in output columns.
ROUTE_MEAL, ROUTE_DATE, ROUTE_TIME, ROUTE_WEEKDAY, ROUTE_TOMORROW = (
    "meal", "date", "time", "weekday", "tomorrow")
