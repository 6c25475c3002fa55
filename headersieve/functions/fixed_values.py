"""Fixed values that the results depend on.

Everything here is data, not logic: header names, word lists, thresholds and
text formats that must be exactly these for the results to come out right.
"""

from __future__ import annotations

# Headers whose relative order is a feature, alphabetical.
ORDER_HEADERS = (
    "Accept",
    "Accept-Encoding",
    "Connection",
    "From",
    "Host",
    "If-Modified-Since",
    "Upgrade-Insecure-Requests",
    "User-Agent",
)

# Headers whose value is a feature, alphabetical.
VALUE_HEADERS = ("Accept", "Accept-Charset", "Accept-Encoding")

# Header names a user agent may arrive under, by preference.
USER_AGENT_HEADERS = ("User-Agent", "user-agent", "user_agent")

# Ordered header pairs that have no slot of their own
# ("<earlier> < <later>"); every other ordered pair of ORDER_HEADERS has one.
PAIRS_WITHOUT_SLOT = (
    ("Accept-Encoding", "From"),
    ("From", "Connection"),
    ("From", "Host"),
    ("From", "If-Modified-Since"),
    ("From", "Upgrade-Insecure-Requests"),
    ("If-Modified-Since", "From"),
    ("Upgrade-Insecure-Requests", "From"),
)

# Fixed value: a claimed browser family is believed above this probability.
HUMAN_THRESHOLD = 0.03

# Fixed value: digits kept of a class probability.
PROBABILITY_DIGITS = 5

# Fixed value: size of the training sample.
TRAINING_SAMPLE = 90000

# Fixed value: inverse regularisation strength of the family classifier.
INVERSE_REGULARISATION = 100.0

# Verdict words.
VERDICT_CRAWLER = "crawler"
VERDICT_HUMAN = "human"
VERDICT_BOT = "bot"
VERDICT_ERROR = "error"
VERDICT_UNKNOWN = "unknown_no_user_agent"

# Class name and code of agents that no signature describes,
# and of agents found in the crawler list.
UNRECOGNIZED_CLASS = ("Unrecognized", "unrecognized")
CRAWLER_CLASS = ("Crawler", "crawler")

# Where the signature data's publisher describes an entry.
BOT_INFO_URL = "https://udger.com/resources/ua-list/bot-detail?bot="
BROWSER_INFO_URL = "https://udger.com/resources/ua-list/browser-detail?browser="
OS_INFO_URL = "https://udger.com/resources/ua-list/client-detail?client="
DEVICE_INFO_URL = "https://udger.com/resources/ua-list/device-detail?device="

# Agent families that are bots.
BOT_FAMILIES = (
    "admantx_platform_semantic_analyzer", "ahrefsbot", "android_httpurlconnection",
    "apache-httpclient", "apache_synapse", "ask_jeeves-teoma", "avast_safezone",
    "avira_crawler", "avira_scout", "baiduspider", "begunadvertising", "bingbot",
    "brandprotect_bot", "cat_explorador", "ccbot", "cliqzbot", "coccocbot", "comodospider",
    "crawler4j", "curl", "demandbase-bot", "dotbot", "duckduckbot", "duckduckgo_app",
    "easybib_autocite", "elinks", "exabot", "extlinksbot", "facebookbot", "feedfetcher_google",
    "feedparser", "flipboardbot", "genieo_web_filter", "getintentcrawler", "girafabot",
    "go_http_package", "google_app", "googlebot", "grapeshotcrawler", "huaweisymantecspider",
    "indy_library", "istellabot", "java", "joc_web_spider", "johnhew_crawler", "kaspersky_bot",
    "leechcraft", "leikibot", "libwww-perl", "linkdexbot", "linkpadbot", "links", "linqiabot",
    "lwp::simple", "lynx", "magpie-crawler", "mail-ru_bot", "maxpointcrawler", "megaindex",
    "metauri", "mj12bot", "mnogosearch", "netcraft_crawler", "netestate_crawler",
    "nettrack_info-bot", "obot", "okhttp", "phantomjs", "php", "plukkie", "pocketparser",
    "poe-component-client-http", "powermarks", "prism", "prlog", "pulsepoint_xt3_web_scraper",
    "python-requests", "python-urllib", "safednsbot", "salesintelligent", "scrapy",
    "scrapy_redis", "seokicks-robot", "seznambot", "silk", "simplepie", "siteexplorer",
    "smtbot", "sogou_spider", "spbot", "sputnikbot", "spyonweb", "startmebot", "surdotlybot",
    "surveybot", "telegrambot", "thinglink_imagebot", "twitterbot", "uptimebot",
    "virusdie_crawler", "virustotal", "w3m", "wget", "winhttp", "wkhtmltopdf",
    "wordpress_pingback", "www::mechanize", "xenu", "yandexbot", "yesupbot", "yoozbot",
)

# Text that gives a crawler away, matched with its case.
CRAWLER_WORDS = (
    "CodeGator", "spbot", "Barkrowler", "HybridBot", "MoodleBot", "www.ru", "Java", "Googlebot",
    "ia_archiver", "Mediapartners-Google", "OpenLinkProfiler.org/bot",
    "www.proximic.com/info/spider", "top100.rambler.ru crawler", "YandexBot", "crawler",
    "Crawler", "Magic Browser", "Microsoft Office Protocol Discovery",
    "Microsoft Office Word 2014", "Spider", "spider", "scraper", "Scraper", "semrushbot",
)
