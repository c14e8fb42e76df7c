"""Fixed values that results depend on."""

from __future__ import annotations

# Statuses.
LIVE_STATUSES = (200, 301, 302, 303, 307, 308)
REFUSED_STATUSES = (401, 403, 407, 451)
THROTTLED_STATUSES = (429, 503)
NO_RESPONSE = -1

# Budgets.
TIMEOUT_S = 10
PDF_TIMEOUT_S = 30
HOST_INTERVAL_S = 1.0
MAX_HOSTS = 32
POLL_ATTEMPTS = 30
POLL_INTERVAL_MS = 2000
BODY_FLOOR = 2000
ATTEMPTS = 3
ATTEMPT_TIMEOUT_S = 180
JITTER_LOW_S, JITTER_HIGH_S = 11, 15
BACKOFF_S = 30
BATCH_SIZE = 32
LIST_SIZE = 1000
LOCK_STALE_MINUTES = 30
BODY_LIMIT = 400_000
URL_LIMIT = 160

# Floors and thresholds.
THIN_FLOOR = 0.5
GEO_FLOOR_M = 1500
EARTH_RADIUS_M = 6_371_000
OVERLAP_FLOOR = 0.05
COVERAGE_THRESHOLD = 0.8
MIN_TEXT = 500
CHALLENGE_PREFIX = 4000
MIN_JPEG_BYTES = 10_000
JPEG_TAIL = 65_536
HIRES_WIDTH = 1400

# Markers.
STICKY_MARKER = "fetch_js"
ITEM_MARKER = "gleaner-item"
RULE_WIDTH = 78
CHALLENGE_TITLE = "just a moment"
AVATAR_MARKERS = ("crop_square",)
PAGE_EXTENSIONS = (".html", ".htm", ".php", ".asp", ".aspx")

# Addresses that are no content.
ASSET = r"\.(png|jpe?g|webp|avif|gif|svg|ico|woff2?|ttf|css|mp4|webm)(\?|$)"
THIRD_PARTY = r"google|gstatic|facebook|analytics|doubleclick|yandex\.ru/metrika|hotjar|segment|sentry"

# Patterns (Java regular expressions).
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
ERROR_ICON = r"(?i)<img[^>]+(error|warning)\.(png|gif|svg)"
TOKEN = "[a-zA-Zа-яА-ЯёЁ]{4,}"
URL_SCHEME = "https?://"
PERCENT_ESCAPE = "%[0-9A-Fa-f]{2}"
FENCE = r"(?s)```([\w+-]*)[ \t]*\n(.*?)\n[ \t]*```"
SELF_REPORT = r"(?i)verification:\s*(\d+)\s+of\s+(\d+)\b([^\n]*)"
PLACEHOLDER = r"\{\{(\w+)\}\}"
VERSION = r"\*\*Prompt version:\s*(\d+)\s*\(([^)]+)\)\.?\*\*"

# Anchors and headings of prompt documents.
PROMPT_BEGIN = "<!-- BEGIN PROMPT -->"
PROMPT_END = "<!-- END PROMPT -->"
REQUIRED_HEADINGS = ("## Drift guard", "## Provenance")

# Flat grey in the lower half of an image that was cut off.
GREY_BANDS = {"bands": 4, "height_start": 0.5, "height_span": 0.45, "strip_px": 4, "target_level": 128, "mean_tolerance": 4, "variance_max": 30, "min_bad_bands": 2}

# Scrolling steps.
SCROLL_STEP_PX = {"text": 700, "images": 500}

# Breaker limits.
BREAKER_LIMITS = {"refused": 1, "throttled": 3, "unreachable": 5}

# Reply buckets, in their order.
BUCKETS = ("unauthorized", "no-block", "unparseable", "unknown-key", "empty-result")

# Closed vocabularies; True: an agent may report it.
VOCABULARIES = {
    "content_status": {"ok": True, "wrong_topic": True, "js_only": True, "scanned_pdf": True, "unverifiable": True, "unchecked": False},
    "coverage_status": {"ok": True, "unparseable": True, "access_blocked": True, "manual": False, "undercoverage": False},
    "verify_verdict": {"confirmed": True, "refuted": True, "uncertain": True},
    "repair_action": {"replace": True, "confirm_walled": True, "drop": True},
}

# Words on challenge pages, error pages and consent buttons, by language.
LOCALES = {
    "en": {
        "challenge_markers": ["just a moment", "attention required", "verifying you are human", "are you a robot", "unusual traffic", "captcha"],
        "soft_error_markers": ["session has expired", "session expired", "insufficient rights", "access denied", "an error occurred", "page not available"],
        "consent_labels": ["I agree", "I accept", "Accept", "Agree", "Allow all", "Got it", "OK"],
    },
    "ru": {
        "challenge_markers": ["доступ ограничен", "подозрительн", "проверка браузера"],
        "soft_error_markers": ["закончилась текущая сессия", "недостаточно прав", "ошибка в параметрах", "доступ запрещен", "сессия истекла"],
        "consent_labels": ["Принять", "Согласен", "Хорошо"],
    },
    "fr": {
        "challenge_markers": ["un instant", "vérification"],
        "soft_error_markers": ["session expirée", "accès refusé"],
        "consent_labels": ["J'accepte", "Accepter", "Tout accepter"],
    },
    "de": {
        "challenge_markers": ["einen moment", "überprüfung"],
        "soft_error_markers": ["sitzung abgelaufen", "zugriff verweigert"],
        "consent_labels": ["Akzeptieren", "Alle akzeptieren", "Zustimmen"],
    },
    "es": {
        "challenge_markers": ["un momento", "verificando"],
        "soft_error_markers": ["sesión expirada", "acceso denegado"],
        "consent_labels": ["Aceptar", "Aceptar todo"],
    },
    "it": {
        "challenge_markers": ["un momento", "verifica in corso"],
        "soft_error_markers": ["sessione scaduta", "accesso negato"],
        "consent_labels": ["Accetta", "Accetta tutto"],
    },
}


def markers(category: str, locales: tuple[str, ...] = ("en",)) -> list[str]:
    """Lower-cased markers of the locales, each once, in order; an unknown locale is an error."""
    return list(dict.fromkeys(m.lower() for code in locales for m in LOCALES[code][category]))


def accepted(vocabulary: str) -> list[str]:
    return list(VOCABULARIES[vocabulary])


def offered(vocabulary: str) -> list[str]:
    return [v for v, from_agent in VOCABULARIES[vocabulary].items() if from_agent]


def derived(vocabulary: str) -> list[str]:
    return [v for v, from_agent in VOCABULARIES[vocabulary].items() if not from_agent]


_MISSING = object()


def get(path: str, default: object = _MISSING) -> object:
    """A fixed value by its dotted name, like ``LOCALES.en.consent_labels``; an unknown name raises unless there is a default."""
    found: object = globals()
    for part in path.split("."):
        if not isinstance(found, dict) or part not in found or part.startswith("_"):
            if default is _MISSING:
                raise KeyError(path)
            return default
        found = found[part]
    return found
