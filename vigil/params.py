"""Parameters of every stage, with their default values.

Keyword maps, thresholds and weights are plain parameters; the defaults
below are the reference configuration's values and must stay as they are
for results to agree with it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for matching results)
# ---------------------------------------------------------------------------

# Indicator patterns, in the reference's extraction order.
IOC_PATTERNS: list[tuple[str, str]] = [
    ("ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("md5", r"\b[a-fA-F0-9]{32}\b"),
    ("sha1", r"\b[a-fA-F0-9]{40}\b"),
    ("sha256", r"\b[a-fA-F0-9]{64}\b"),
    ("url", r"\bhttps?://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+\b"),
    ("domain", r"\b(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,}\b"),
]

# Token pattern of the preprocessing tokenizer.
TOKEN_PATTERN = r"[A-Za-z0-9][A-Za-z0-9_\-\.:/@%\+=]*"

# ATT&CK tactics in order, each with its keywords (lower-case substrings).
MITRE_TACTICS: list[tuple[str, list[str]]] = [
    ("Initial Access", ["phishing", "spearphish", "drive-by", "exploit", "malvertising"]),
    ("Execution", ["malware", "payload", "ransomware", "dropper"]),
    ("Persistence", ["persistence", "backdoor", "autorun", "registry"]),
    ("Privilege Escalation", ["privilege escalation", "elevation"]),
    ("Defense Evasion", ["obfuscation", "evas", "anti-debug"]),
    ("Credential Access", ["credential", "password", "hashdump", "token"]),
    ("Discovery", ["scan", "recon", "enumeration"]),
    ("Lateral Movement", ["lateral", "pivot", "remote exec"]),
    ("Collection", ["exfil", "collection", "archive"]),
    ("Command and Control", ["c2", "command and control", "beacon"]),
    ("Exfiltration", ["exfiltration", "data leak", "data breach"]),
    ("Impact", ["ddos", "denial of service", "destruction", "encryption"]),
]

# Fallback keyword classifiers (label -> keywords), in configured order.
INCIDENT_KEYWORDS: dict[str, list[str]] = {
    "phishing": ["phish", "credential", "spoof", "fake login", "otp"],
    "malware": ["malware", "trojan", "ransomware", "payload"],
    "ddos": ["ddos", "denial of service", "botnet"],
    "breach": ["data breach", "leak", "exfiltration"],
}
SECTOR_KEYWORDS: dict[str, list[str]] = {
    "banking": ["bank", "fintech", "payment", "upi"],
    "government": ["gov", "government", "ministry", "department"],
    "telecom": ["telecom", "isp", "mobile operator"],
    "healthcare": ["hospital", "healthcare", "clinic"],
}

# Weak-labelling keyword lists, merged after the fallback lists.
WEAK_INCIDENT_KEYWORDS: dict[str, list[str]] = {
    "phishing": ["phishing", "credential", "spoof", "fake login", "otp", "smishing", "vishing"],
    "malware": ["malware", "trojan", "ransomware", "payload", "backdoor", "dropper"],
    "ddos": ["ddos", "denial of service", "botnet", "traffic flood"],
    "breach": ["data breach", "leak", "exfiltration", "exposed data"],
}
WEAK_SECTOR_KEYWORDS: dict[str, list[str]] = {
    "banking": ["bank", "fintech", "payment", "upi", "atm", "netbanking"],
    "telecom": ["telecom", "telco", "isp", "mobile operator", "5g", "4g"],
    "healthcare": ["hospital", "healthcare", "clinic", "patient", "medical"],
    "govt": ["government", "ministry", "department", "public sector", "psu"],
    "defence": ["defence", "defense", "military", "drdo", "mod"],
    "finance": ["finance", "sebi", "irdai", "insurance", "nbfc"],
    "corporate": ["corporate", "enterprise", "company", "firm", "business"],
}
SOURCE_DOMAIN_MAP: dict[str, str] = {
    "rbi.org.in": "banking",
    "sebi.gov.in": "corporate",
    "irdai.gov.in": "finance",
    "trai.gov.in": "telecom",
    "dot.gov.in": "telecom",
    "mohfw.gov.in": "healthcare",
    "drdo.gov.in": "defence",
    "cert-in.org.in": "govt",
    "pib.gov.in": "govt",
}

# Source groups in the order their sources are read.
SOURCE_GROUP_ORDER = ["paste_sites", "forums", "telegram_channels", "advisories", "blogs", "threat_feeds"]

# Default noise-line patterns.
NOISE_PATTERNS = ["^share$", "^forwarded$"]

# Severity labels from highest to lowest.
SEVERITY_LABELS = ["high", "medium", "low", "informational"]

# ---------------------------------------------------------------------------
# Own choices (not reference values)
# ---------------------------------------------------------------------------

# Language profiles: frequent function words that are specific to one
# language. Used by the stop-word language detector (replaces an external
# detection library). Ties go to the first language in this order.
LANGUAGE_PROFILES: list[tuple[str, list[str]]] = [
    ("de", ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "für", "ein",
            "ist", "nicht", "dem", "im", "als", "eine"]),
    ("en", ["the", "of", "and", "to", "is", "that", "it", "for", "was", "on", "with", "be",
            "by", "as", "this", "are", "at", "from"]),
    ("es", ["el", "y", "los", "se", "del", "las", "por", "no", "con", "su", "una", "para",
            "al", "lo", "es"]),
    ("fr", ["le", "les", "et", "des", "du", "une", "pour", "est", "qui", "dans", "sur", "au",
            "pas", "avec", "aux", "elle"]),
]

# A subset of the public suffix list (ICANN section) used to find the
# registrable part of a domain name. Two-label suffixes must be listed
# explicitly; anything not listed is treated as having no known suffix.
PUBLIC_SUFFIXES: list[str] = [
    "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "mobi",
    "io", "co", "ai", "app", "dev", "me", "tv", "cc", "ws", "xyz", "online", "site", "top",
    "club", "shop", "store", "tech", "cloud", "live", "news", "blog", "zip", "link", "asia", "eu",
    "us", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "nhs.uk",
    "in", "co.in", "net.in", "org.in", "gov.in", "ac.in", "edu.in", "res.in", "nic.in", "firm.in",
    "gen.in", "ind.in", "mil.in",
    "de", "fr", "es", "it", "nl", "be", "ch", "at", "se", "no", "dk", "fi", "pl", "cz", "pt",
    "ie", "gr", "hu", "ro", "bg", "sk", "si", "hr", "lt", "lv", "ee", "lu", "is",
    "ru", "ua", "by", "kz", "tr", "com.tr", "il", "co.il", "ir", "ae", "sa", "com.sa", "eg",
    "cn", "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "hk", "com.hk", "tw", "com.tw",
    "jp", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "kr", "co.kr", "or.kr",
    "sg", "com.sg", "my", "com.my", "id", "co.id", "th", "co.th", "vn", "com.vn", "ph", "com.ph",
    "pk", "com.pk", "bd", "com.bd", "lk", "np",
    "au", "com.au", "net.au", "org.au", "gov.au", "edu.au", "nz", "co.nz", "org.nz",
    "ca", "mx", "com.mx", "br", "com.br", "ar", "com.ar", "cl", "com.co", "pe", "ve",
    "za", "co.za", "ng", "com.ng", "ke", "co.ke",
]


# ---------------------------------------------------------------------------
# Stage parameters
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class PreprocessParams:
    min_text_length: int = 20
    min_token_length: int = 2
    noise_patterns: tuple[str, ...] = tuple(NOISE_PATTERNS)
    allowed_languages: tuple[str, ...] = ()
    language_profiles: tuple[tuple[str, tuple[str, ...]], ...] = tuple((lang, tuple(words)) for lang, words in LANGUAGE_PROFILES)


@dataclass(frozen=True)
class IocParams:
    confidence: float = 0.75
    context_window: int = 40
    suffixes: tuple[str, ...] = tuple(PUBLIC_SUFFIXES)


@dataclass(frozen=True)
class ClassifierParams:
    label_keywords: dict = field(default_factory=dict)
    min_confidence: float = 0.6


@dataclass(frozen=True)
class CorrelationParams:
    temporal_window_hours: int = 24
    min_shared_iocs: int = 1
    min_campaign_size: int = 2
    use_analysis_clusters: bool = True
    use_temporal_window: bool = True
    w_shared_ioc: float = 0.4
    w_analysis_cluster: float = 0.2
    w_temporal: float = 0.2
    w_incident_conf: float = 0.1
    w_sector_conf: float = 0.1


@dataclass(frozen=True)
class ScoringParams:
    low: float = 0.3
    medium: float = 0.6
    high: float = 0.8
    w_incident_conf: float = 0.35
    w_sector_conf: float = 0.15
    w_correlation_conf: float = 0.30
    w_ioc_count: float = 0.10
    w_mitre_tactics: float = 0.10


@dataclass(frozen=True)
class WeakLabelParams:
    weight_text: float = 1.0
    weight_domain: float = 0.7
    incident_min_score: float = 1.0
    sector_min_score: float = 0.6
    margin: float = 0.2
    min_class_count: int = 5


def incident_classifier() -> ClassifierParams:
    return ClassifierParams(label_keywords=dict(INCIDENT_KEYWORDS), min_confidence=0.6)


def sector_classifier() -> ClassifierParams:
    return ClassifierParams(label_keywords=dict(SECTOR_KEYWORDS), min_confidence=0.6)


# Briefing wording.
BRIEF_SCOPE = ("Scope", "This summary reflects ", "the available",
               " events from the latest Cyber Threat Intelligence run so analysts can prioritize review.")
BRIEF_INCIDENTS = ("Incident focus", "Most common incident types: ", "a broad mix of incident types")
BRIEF_SECTORS = ("Sector exposure", "Most touched sectors: ", "multiple sectors")
BRIEF_SIGNAL = ("Severity signal", "Severity labels are derived from confidence, correlation strength, and the volume "
                "of Indicators of Compromise tied to each event.")
BRIEF_SEVERITY = ("Severity distribution", "%d high, %d medium, %d low, and %d informational items were observed in this run.")
BRIEF_INDICATORS = ("Indicators of Compromise", "Approximately %d Indicators of Compromise were captured, including network addresses, domains, URLs, and file hashes.",
                    "No Indicators of Compromise were captured, which can occur when sources provide narrative-only detail.")
BRIEF_CAMPAIGNS = ("Campaign grouping", "Campaign grouping shows %d cluster%s of shared infrastructure and timing.",
                   "Campaign grouping did not form clusters, suggesting isolated or early-stage activity.")
BRIEF_TACTICS = ("MITRE ATT&CK mapping", "Most frequent tactics: ", "several common tactics",
                 "MITRE ATT&CK mapping coverage is limited; treat tactic gaps as verification tasks.")
BRIEF_ACTION = ("Analyst action", "Validate high-priority items against internal logs, then use the report to guide "
                "monitoring, threat hunting, and detection tuning.")
BRIEF_POSTURE = ("Defensive posture", "This report is defensive only. Treat public-source indicators as leads until "
                 "corroborated by internal evidence.")
