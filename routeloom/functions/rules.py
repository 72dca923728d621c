"""Values that addresses, chains and the work area are read by.

They are fixed: results are right only with these words, boxes and numbers. Everything that
can be built from a rule (abbreviation patterns, marker tests) is built in `text.py`.
"""

# Abbreviations and the words that they stand for.
STREET_ABBREVIATIONS = (
    ("ул", "улица"),
    ("пр-т", "проспект"),
    ("просп", "проспект"),
    ("пр", "проспект"),
    ("наб", "набережная"),
    ("пер", "переулок"),
    ("пл", "площадь"),
    ("ш", "шоссе"),
    ("б-р", "бульвар"),
    ("бул", "бульвар"),
    ("бульв", "бульвар"),
)
HOUSE_ABBREVIATIONS = (("д", "дом"), ("корп", "корпус"), ("к", "корпус"), ("стр", "строение"), ("лит", "литера"))
STREET_TYPES = ("улица", "проспект", "переулок", "набережная", "площадь", "шоссе", "бульвар", "линия")

# Names of the two regions.
CITY = "Санкт-Петербург"
REGION = "Ленинградская область"
CITY_ALIASES = ("спб", "с-пб", "санкт-петербург", "санкт петербург", "петербург", "питер")
REGION_CODES = {"78": CITY, "47": REGION}

# Settlements of the city and of the region: latitude, longitude, radius in km.
CITY_SETTLEMENTS = {
    "колпино": (59.7507, 30.5886, 15.0),
    "пушкин": (59.7200, 30.4167, 15.0),
    "павловск": (59.6833, 30.4347, 15.0),
    "петергоф": (59.8845, 29.8852, 15.0),
    "ломоносов": (59.9107, 29.7725, 15.0),
    "кронштадт": (59.9911, 29.7775, 15.0),
    "сестрорецк": (60.0939, 29.9580, 15.0),
    "зеленогорск": (60.1997, 29.7018, 15.0),
    "красное село": (59.7383, 30.0867, 15.0),
    "шушары": (59.8092, 30.3760, 12.0),
    "парголово": (60.0813, 30.2642, 12.0),
    "песочный": (60.1231, 30.1640, 12.0),
    "левашово": (60.1030, 30.2090, 12.0),
}
REGION_SETTLEMENTS = {
    "мурино": (60.0444, 30.4486, 12.0),
    "кудрово": (59.9078, 30.5128, 12.0),
    "всеволожск": (60.0191, 30.6457, 18.0),
    "бугры": (60.0711, 30.3917, 10.0),
    "новое девяткино": (60.0617, 30.4806, 10.0),
    "янино": (59.9486, 30.5586, 10.0),
    "янино-1": (59.9486, 30.5586, 10.0),
    "колтуши": (59.9294, 30.6442, 10.0),
    "сертолово": (60.1444, 30.2119, 15.0),
    "токсово": (60.1539, 30.5169, 15.0),
    "гатчина": (59.5650, 30.1281, 20.0),
    "тосно": (59.5408, 30.8775, 20.0),
    "кириши": (59.4471, 32.0205, 20.0),
    "выборг": (60.7131, 28.7329, 20.0),
    "кировск": (59.8753, 30.9815, 15.0),
    "отрадное": (59.7728, 30.7944, 12.0),
    "шлиссельбург": (59.9444, 31.0339, 12.0),
    "приозерск": (61.0331, 30.1588, 20.0),
}
# Places whose mention makes the default city superfluous.
CITY_MARKERS = (
    "санкт-петербург", "ленинградская область", "петергоф", "ломоносов", "кронштадт", "сестрорецк", "зеленогорск",
    "красное село", "колпино", "пушкин", "павловск", "шушары", "парголово", "мурино", "кудрово", "всеволожск",
    "кириши", "гатчина", "тосно", "выборг", "нурма",
)

# The work area and the area of place imports, as least and greatest latitude and longitude.
WORK_AREA = (58.30, 61.40, 27.20, 35.80)
PLACE_AREA = (58.35, 61.35, 27.0, 35.8)

# Words that say nothing about a candidate, and those that say nothing about a street.
STOP_WORDS = ("г", "город", "дом", "д", "корпус", "к", "строение", "литера", "санкт", "петербург", "санкт-петербург", "ленинградская", "область", "россия")
STREET_STOP_WORDS = (
    "санкт", "петербург", "ленинградская", "ленобласть", "область", "город", "кириши", "улица", "проспект", "переулок",
    "набережная", "площадь", "шоссе", "бульвар", "линия", "дом", "корпус", "строение", "литера",
)
#: Type words that a street's bare name leaves out.
STREET_TYPE_WORDS = (
    "улица", "ул", "проспект", "пр-т", "пр", "переулок", "пер", "набережная", "наб", "площадь", "пл", "шоссе", "ш",
    "бульвар", "бул", "проезд", "линия",
)

# Shop tags that speak for a place, what warnings cost, and the tags that may name a brand, best first.
GOOD_SHOPS = ("supermarket", "convenience", "department_store", "greengrocer", "yes")
WARNING_COSTS = {"ADDRESS_MISSING": 0.2, "SHOP_TAG_MISSING": 0.2, "DUPLICATE_CANDIDATE": 0.2, "GEOMETRY_UNCERTAIN": 0.3}
BRAND_TAGS = ("brand", "brand:ru", "operator", "operator:ru", "name", "name:ru", "name:en", "official_name", "short_name", "alt_name", "old_name", "description")

# Words of delivery sheets.
STORES = ("Агроторг", "Перекресток", "Пятерочка", "Семишагофф", "Магнит", "Дикси", "Лента", "Окей")
NOISE_WORDS = ("дата", "панорам", "адрес", "склад", "документы", "поставил", "возврат", "офис", "тел", "телефон")

# Contexts that a search starts from when nothing else is given: label, latitude, longitude, radius in km.
DEFAULT_CONTEXT = (CITY, 59.9386, 30.3141, 60.0)
WIDE_CONTEXT = (f"{CITY} и ближайшая {REGION}", 59.9386, 30.3141, 120.0)

# Words of a text that name a district, in this order.
DISTRICT_HINTS = (
    ("васильевск", "Василеостровский"), ("п.с.", "Петроградский"), ("малый проспект п.с", "Петроградский"), ("малая посадская", "Петроградский"),
    ("чапаева", "Петроградский"), ("чкалов", "Петроградский"), ("пушкар", "Петроградский"), ("пионерская", "Петроградский"), ("константиновск", "Петроградский"),
    ("лермонтов", "Адмиралтейский"), ("горохов", "Адмиралтейский"), ("подольск", "Адмиралтейский"), ("измайлов", "Адмиралтейский"), ("ефимова", "Адмиралтейский"),
    ("троицк", "Адмиралтейский"), ("егорова", "Адмиралтейский"), ("английск", "Адмиралтейский"), ("казанск", "Адмиралтейский"),
    ("некрасова", "Центральный"), ("марата", "Центральный"), ("владимир", "Центральный"), ("мытнин", "Центральный"), ("перекупной", "Центральный"),
    ("караван", "Центральный"), ("черняхов", "Центральный"), ("пестеля", "Центральный"), ("кироочная", "Центральный"), ("кирочная", "Центральный"),
    ("невский", "Центральный"), ("чайковского", "Центральный"),
    ("бобыль", "Петродворцовый"), ("новоселье", "Петродворцовый"), ("львовская", "Петродворцовый"), ("разводная", "Петродворцовый"), ("александровская", "Петродворцовый"),
    ("шахматова", "Петродворцовый"), ("современников", "Петродворцовый"), ("ораниенбаум", "Петродворцовый"), ("костылева", "Петродворцовый"), ("красносельское", "Петродворцовый"),
    ("швейцарская", "Петродворцовый"), ("ропшинское", "Петродворцовый"), ("санкт-петербургское", "Петродворцовый"), ("антоненко", "Петродворцовый"),
)
# Districts as least and greatest latitude, least and greatest longitude, in this order.
DISTRICT_BOXES = (
    ("Кронштадт", 59.95, 60.04, 29.62, 29.86), ("Курортный", 60.00, 60.25, 29.70, 30.18), ("Петродворцовый", 59.82, 59.94, 29.65, 30.18),
    ("Красносельский", 59.72, 59.90, 30.05, 30.25), ("Кировский", 59.83, 59.91, 30.20, 30.31), ("Московский", 59.80, 59.91, 30.28, 30.40),
    ("Фрунзенский", 59.82, 59.90, 30.33, 30.45), ("Колпинский", 59.70, 59.85, 30.45, 30.75), ("Пушкинский", 59.65, 59.85, 30.25, 30.55),
    ("Невский", 59.84, 59.95, 30.38, 30.58), ("Василеостровский", 59.92, 60.00, 30.18, 30.30), ("Петроградский", 59.94, 60.02, 30.22, 30.35),
    ("Адмиралтейский", 59.90, 59.95, 30.25, 30.36), ("Центральный", 59.92, 59.98, 30.31, 30.40), ("Приморский", 59.98, 60.12, 30.10, 30.31),
    ("Выборгский", 60.00, 60.12, 30.20, 30.40), ("Калининский", 59.98, 60.07, 30.32, 30.45), ("Красногвардейский", 59.93, 60.02, 30.39, 30.58),
)

# Towns that delivery sheets name, and those whose houses have no street.
SHEET_TOWNS = ("Санкт-Петербург", "СПб", "Коммунар", "Гатчина", "Вырица", "Луга", "Сиверский", "Мшинская", "Пудомяги", "Белогорка", "Мины", "Дружная Горка", "Семрино", "Сусанино", "Форносово")
HOUSE_ONLY_TOWNS = ("Пудомяги", "Сусанино", "Форносово", "Белогорка", "Мины", "Семрино")
# What recognition makes of words and phrases (in small letters, without dots), and what they are.
MISREAD_WORDS = {
    "yn": "ул.", "ya": "ул.", "yx": "ул.", "уп": "ул.", "np": "пр.", "pr": "пр.", "пуга": "Луга", "nyra": "Луга", "мимы": "Мины", "дружмая": "Дружная", "жепезнодорожмая": "Железнодорожная", "стронктелей": "Строителей",
    "строктелей": "Строителей", "героее": "Героев", "соболовского": "Соболевского", "соболеоского": "Соболевского", "хвалыиская": "Хвалынская", "сусаниио": "Сусанино", "оммунар": "Коммунар",
}
MISREAD_PHRASES = {"г ороев": "Героев", "гатчинска ул": "Гатчинская ул", "урицкого пр 713": "Урицкого пр. 77/3", "урицкого пр 73": "Урицкого пр. 77/3", "урицкого пр - 73": "Урицкого пр. 77/3", "урицкого пр-73": "Урицкого пр. 77/3"}
# Street types of sheets, the parts of a house, the marks of a house and a town, and what in an address speaks for a street.
SHEET_TYPES = ("ул", "улица", "пр", "проспект", "ш", "шоссе", "пер", "переулок", "пл", "площадь", "наб", "набережная", "б-р", "бульвар", "линия", "пр-д", "проезд")
SHEET_PARTS = ("к", "корп", "лит", "стр")
HOUSE_MARK, TOWN_MARK = "д", "г"
STREET_SIGNS = ("ул", "пр", "ш", "наб", "линия")
# What speaks for an address in a table's cell, for a header row, and for a fragment of a line.
CELL_MARKERS = ("ул", "улица", "пр", "проспект", "пр-т", "шоссе", "наб", "набережная", "пер", "переулок", "пл", "площадь", "дом", "д.", "корп", "лит", "санкт-петербург", "спб", "ленинградская")
HEADER_MARKERS = ("адрес", "название", "магазин", "комментар", "номер", "order", "address", "name")
FRAGMENT_WORDS = ("а", "в", "и", "ул", "кая", "ков", "срое")
FRAGMENT_STARTS = ("ыкников ", ". ", "- ", "в пр", "а хвал")

# Types of streets in suggestions and the words that they stand for.
SUGGEST_TYPES = {
    "ул": "улица", "улица": "улица", "улицы": "улица", "пр": "проспект", "просп": "проспект", "пр-т": "проспект", "проспект": "проспект", "пер": "переулок", "переулок": "переулок",
    "наб": "набережная", "набережная": "набережная", "пл": "площадь", "площадь": "площадь", "ш": "шоссе", "шоссе": "шоссе", "б-р": "бульвар", "бул": "бульвар", "бульвар": "бульвар",
}
SUGGEST_BARE_TYPES = ("проезд", "дорога", "линия")
SUGGEST_CITY_TOKENS = ("санкт", "петербург", "ленинградская", "область", "россия")
SUGGEST_CITY_PREFIXES = ("санкт-петербург", "санкт петербург", "спб", "петербург", "ленинградская область", "россия")
SUGGEST_CITY_PARTS = ("санкт-петербург", "санкт петербург", "спб")
HIGHWAY_KINDS = ("road", "residential", "primary", "secondary", "tertiary", "unclassified", "service", "living_street", "pedestrian")
SECONDARY_KEYS = ("shop", "amenity", "tourism", "building", "allotments", "neighbourhood", "quarter", "suburb", "city_district", "municipality", "hamlet", "village", "town", "city", "county", "state_district", "state", "postcode", "country")
