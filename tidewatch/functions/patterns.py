"""Patterns, word lists and tables that results must agree with. Patterns are in the dialect that Java and RE2 share."""

# Indicator patterns.
CVE = r"(?i)CVE-\d{4}-\d{4,7}"
CVE_LOOSE = r"(?i)(?<![A-Za-z0-9-])(?:CVE[-\s]?)?(\d{4})[-\s](\d{4,})(?!-[0-9a-fA-F]{4})"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV4_OCTETS = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
DOMAIN_PAIR = r"(?i)\b[a-z0-9][a-z0-9-]*\.[a-z]{2,}\b"
DOMAIN_FULL = r"\b(?:(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)\.)+(?:[A-Za-z]{2,63})\b"
HASH = r"(?i)\b[a-f0-9]{32,64}\b"
HASH_EXACT = r"\b(?:[a-fA-F0-9]{128}|[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b"
HASH_LABELLED = (
    r"(?i)(?:md5|sha1|sha256|sha512)[\s:=]+([a-fA-F0-9]{32,128})",
    r"(?i)(?:hash|checksum)[\s:=]+([a-fA-F0-9]{32,128})",
    r"(?i)([a-fA-F0-9]{32,128})[\s]*(?:\(md5\)|\(sha1\)|\(sha256\)|\(sha512\))",
)
SHA256 = r"\b[a-fA-F0-9]{64}\b"
TECHNIQUE = r"\bT\d{4}(?:\.\d{3})?\b"
ACTORS = r"(?i)\b(?:TA402|APT-C-23|IronWind|NimbleMamba|SharpSploit|Molerats|Arid\s+Viper)\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
EMAIL_DEFANGED = r"\b[A-Za-z0-9._%+-]+\[@\][A-Za-z0-9.-]+\[\.\][A-Z|a-z]{2,}\b"
PROCESS = r"(?i)\b[a-zA-Z0-9_-]{3,30}\.exe\b"
URL = r"(?i)\bhttps?://[^\s<>\"']+"
URL_DEFANGED = r"(?i)\bhxxps?(?:\[:\]|:)//[^\s<>\"']+"
CIDR = r"\b(?:\d{1,3}\.){3}\d{1,3}/\d{1,2}\b"
IPV4_DEFANGED = r"\b\d{1,3}\[\.\]\d{1,3}\[\.\]\d{1,3}\[\.\]\d{1,3}\b"
FILE_PATHS = (
    r"[A-Za-z]:\\[^\\/:*?\"<>|\r\n]+\\[^\\/:*?\"<>|\r\n]+\.[a-zA-Z0-9]{2,5}",
    r"[A-Za-z]:\\[^\\/:*?\"<>|\r\n]+\\[^\\/:*?\"<>|\r\n]+",
    r"/(?:tmp|var|home|opt|usr|etc|bin|sbin|root|boot|dev|proc|sys|lib|lib64|run|srv|mnt|media)/[^/\s]+(?:/[^/\s]+)*(?:\.[a-zA-Z0-9]{2,5})?",
    r"/[^/\s]+/[^/\s]+\.[a-zA-Z0-9]{2,5}",
    r"\.{1,2}/[^/\s]+(?:/[^/\s]+)*(?:\.[a-zA-Z0-9]{2,5})?",
    r"(?i)%[A-Z_]+%\\[^\\/:*?\"<>|\r\n]+(?:\\[^\\/:*?\"<>|\r\n]+)*",
)
PATH_STOP_WORDS = ("http", "www", "mailto:", "javascript:", "data:", "about:", "chrome:", "file://", "ftp://", "ssh://", "[.]", "hxxp", "suspicious", "detected", "blocked")
REGISTRY = (
    r"(?i)(?:HKEY_[A-Z_]+|HKLM|HKCU|HKCR|HKU|HKCC)\\[^\\]+(?:\\[^\\]+)*",
    r"(?i)\\Registry\\Machine\\[^\\]+(?:\\[^\\]+)*",
    r"(?i)(?:(?:HKEY_[A-Z_]+|HKLM|HKCU|HKCR|HKU|HKCC)\\)?(?:SOFTWARE|SYSTEM)\\[^\\]+(?:\\[^\\]+)*",
)
REGISTRY_ROOTS = ("HKEY_CLASSES_ROOT", "HKCR", "HKEY_CURRENT_USER", "HKCU", "HKEY_LOCAL_MACHINE", "HKLM", "HKEY_USERS", "HKU", "HKEY_CURRENT_CONFIG", "HKCC", "HKEY_PERFORMANCE_DATA", "HKEY_DYN_DATA")
COMMANDS = (
    r"(?i)(?:powershell|cmd)(?:\.exe)?\s+(?:-[a-zA-Z]+\s+|/[a-zA-Z]+\s+|&\s*|;|\$)[^\r\n]{10,}",
    r"(?i)-(?:enc|encodedcommand)\s+[A-Za-z0-9+/=]{20,}",
    r"(?i)(?:sc|net|reg)\s+(?:create|add|start|stop|delete|query)\s+[^\r\n]{5,}",
    r"(?i)(?:certutil|bitsadmin)\s+-[^\r\n]{10,}",
    r"(?i)wget\s+http[^\r\n\s]+",
    r"(?i)curl\s+(?:-[a-zA-Z]\s+)*http[^\r\n\s]+",
)
COMMAND_NARRATIVE = r"(?i)\b(?:has used|have used|uses|utilized|employs|leverages|executes|APT\d+|threat actor|malware|campaign)\b|\[[0-9]+\]"
FILE_SUFFIXES = (
    "exe", "dll", "sys", "bin", "bat", "cmd", "scr", "class", "jar", "war", "ear", "doc", "docx", "pdf", "txt", "rtf", "xls", "xlsx", "ppt", "pptx",
    "zip", "rar", "7z", "tar", "gz", "bz2", "jpg", "jpeg", "png", "gif", "bmp", "ico", "svg", "xml", "json", "yml", "yaml", "cfg", "conf", "ini", "log",
    "c", "cpp", "h", "py", "rb", "pl", "java", "cs", "vb", "php", "html", "htm", "asp", "jsp", "cgi", "js", "css",
)
PLACEHOLDER_HOSTS = ("example.com", "test.com", "localhost")
TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "_ga", "_gl", "mc_eid", "mc_cid")

# Address blocks in the order in which they are tried: first address, prefix length, reason, kind.
IPV4_BLOCKS = (
    ("10.0.0.0", 8, "RFC 1918 private address space", "Private"),
    ("172.16.0.0", 12, "RFC 1918 private address space", "Private"),
    ("192.168.0.0", 16, "RFC 1918 private address space", "Private"),
    ("100.64.0.0", 10, "Carrier-Grade NAT address space (RFC 6598)", "Shared"),
    ("127.0.0.0", 8, "Loopback address space", "Loopback"),
    ("169.254.0.0", 16, "Link-local/APIPA address space", "Link-local"),
    ("192.0.2.0", 24, "TEST-NET-1 documentation address space", "Documentation"),
    ("198.51.100.0", 24, "TEST-NET-2 documentation address space", "Documentation"),
    ("203.0.113.0", 24, "TEST-NET-3 documentation address space", "Documentation"),
    ("0.0.0.0", 8, "Special use address space (this network)", "Special"),
    ("224.0.0.0", 4, "Multicast address space", "Multicast"),
    ("240.0.0.0", 4, "Reserved/future use address space", "Reserved"),
)

# Text classifiers; all are matched on lower-cased text.
TENSION = (
    r"\b(?:national\s+security|critical\s+infrastructure|government|military|defense)\b",
    r"\b(?:widespread|massive|significant|critical|severe|major)\s+(?:attack|breach|incident)\b",
    r"\b(?:state\s+sponsored|nation\s+state|apt|advanced\s+persistent)\b",
    r"\b(?:cyber\s+warfare|cyber\s+attack|cyber\s+operation)\b",
    r"\b(?:espionage|intelligence|surveillance)\b",
    r"\b(?:election|voting|democracy|political)\b.*(?:attack|interference|manipulation)\b",
)
MOTIVATIONS = {
    "financial": (
        r"\b(?:money|profit|financial|ransom|extortion|cryptocurrency|bitcoin|payment)\b",
        r"\b(?:banking|financial|credit\s+card|payment\s+system)\b.*(?:attack|breach|fraud)\b",
    ),
    "espionage": (
        r"\b(?:espionage|intelligence|surveillance|reconnaissance|data\s+theft)\b",
        r"\b(?:steal|exfiltrate|collect).*(?:information|data|secrets|documents)\b",
        r"\b(?:state\s+sponsored|nation\s+state|government|military)\b.*(?:actor|group)\b",
    ),
    "hacktivism": (
        r"\b(?:hacktivist|hacktivism|activist|protest|political)\b",
        r"\b(?:anonymous|defacement|website\s+defacement)\b",
        r"\b(?:political|ideological|social)\s+(?:motivation|cause|agenda)\b",
    ),
    "extortion": (
        r"\b(?:extortion|blackmail|ransom|ransomware)\b",
        r"\b(?:pay|payment|bitcoin|cryptocurrency).*(?:decrypt|unlock|restore)\b",
    ),
    "sabotage": (
        r"\b(?:sabotage|disruption|destruction|damage)\b",
        r"\b(?:industrial|infrastructure|utility|power|energy)\b.*(?:attack|disruption)\b",
        r"\b(?:scada|ics|industrial\s+control)\b",
    ),
}
RELEVANCE = (
    (8, (r"(?i)\bCVE-\d{4}-\d+\b", r"(?i)\b(?:APT|UNC|TA)\d+\b", r"\b[a-fA-F0-9]{32,64}\b", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"(?i)https?://[^\s]+")),
    (6, (r"(?i)\b(?:malware|trojan|ransomware|backdoor|exploit)\b", r"(?i)\b(?:phishing|spearphishing|c2|command.and.control)\b", r"(?i)\b(?:vulnerability|zero.day|patch|mitigation)\b")),
    (4, (r"(?i)\b(?:security|cyber|attack|threat|breach)\b", r"(?i)\b(?:firewall|antivirus|detection|monitoring)\b")),
)
CYBER_WORDS = r"(?i)cyber|malware|vulnerability|attack|threat|exploit|breach"
ZERO_DAY = r"(?i)zero-day|0-day|zero day|unknown vulnerability|undisclosed vulnerability|no patch available|unpatched vulnerability"
EXPLOITED = r"(?i)actively exploited|exploitation in the wild|attacks observed|threat actors are using|campaigns targeting"
GEO_SINGAPORE = r"(?i)\bsingapore\b|\.sg\b|\bCSA\b|\bMHA\b|\bGovTech\b"
GEO_ASEAN = r"(?i)\b(?:asean|malaysia|indonesia|thailand|vietnam|philippines|brunei|cambodia|laos|myanmar)\b"
SUMMARY_FACTS = {
    "Threat Actors": r"(?i)\b(?:APT|UNC|TA)\d+\b",
    "Malware": r"(?i)\b\w*(?:trojan|malware|ransomware|backdoor|loader)\w*\b",
    "Cves": r"(?i)\bCVE-\d{4}-\d+\b",
    "Iocs": r"(?i)\b(?:\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|[a-fA-F0-9]{32,64}|https?://[^\s]+)\b",
    "Techniques": r"(?i)\bT\d{4}(?:\.\d{3})?\b",
}
# Behaviour words and the techniques that they point to.
BEHAVIOURS = (
    ("phishing", "T1566.001"), ("phishing", "T1566.002"), ("macro", "T1059.005"), ("macro", "T1204.002"), ("powershell", "T1059.001"), ("cmd", "T1059.003"),
    ("process injection", "T1055"), ("registry", "T1112"), ("registry", "T1547.001"), ("credential dumping", "T1003.001"), ("credential dumping", "T1003.002"),
    ("network scanning", "T1018"), ("network scanning", "T1016"), ("encryption", "T1486"), ("web shell", "T1505.003"), ("scheduled task", "T1053.005"),
    ("dll", "T1574.002"), ("living-off-the-land", "T1218"), ("c2", "T1071.001"), ("c2", "T1102"), ("exfiltration", "T1041"), ("exfiltration", "T1567.002"),
)
TECHNIQUE_CONTEXT = r"(?i)MITRE|ATT&CK|technique|tactic|uses|employs"
TECHNIQUE_WORDS = ("MITRE", "ATT&CK", "technique", "tactic", "uses", "employs")
TECHNIQUE_NOT_BEFORE = r"[/\\\\_-]|(?i:version|model|product|release) "
TECHNIQUE_NOT_AFTER = r"[/\\\\_]|-\w"

# Content detectors, each with the weight of one match.
KIND_PATTERNS = {
    "STIX": (0.15, (r'(?i)"type"\s*:\s*"bundle"', r'(?i)"spec_version"\s*:\s*"2\.[01]"', r'(?i)"type"\s*:\s*"indicator"', r'(?i)"type"\s*:\s*"malware"', r'(?i)"type"\s*:\s*"threat-actor"', r'(?i)"type"\s*:\s*"attack-pattern"', r'(?i)"pattern"\s*:\s*"\[.*\]"', r'(?i)"labels"\s*:\s*\[.*"malicious-activity"')),
    "MISP": (0.15, (r'(?i)"Event"\s*:\s*\{', r'(?i)"Attribute"\s*:\s*\[', r'(?i)"orgc_id"\s*:', r'(?i)"sharing_group_id"\s*:', r'(?i)"published"\s*:\s*(true|false)', r'(?i)"threat_level_id"\s*:', r'(?i)"analysis"\s*:\s*"[012]"', r'(?i)"category"\s*:\s*"(Network activity|Payload|Artifacts|Attribution)"')),
    "RSS": (0.15, (r"(?i)<rss\s+version=", r"(?i)<feed\s+xmlns=", r"(?i)<channel>", r"(?i)<item>", r"(?i)<entry>", r"(?i)<title>.*</title>", r"(?i)<description>", r"(?i)<pubDate>", r"(?i)<lastBuildDate>")),
    "HTML": (0.1, (r"(?i)<!DOCTYPE\s+html", r"(?i)<html[^>]*>", r"(?i)<head>", r"(?i)<body>", r"(?i)<title>.*</title>", r"(?i)<meta\s+[^>]*>", r"(?i)<div[^>]*>", r"(?i)<p[^>]*>")),
}

# Name lists of the span tagger.
MALWARE_NAMES = ("Emotet", "Zeus", "TrickBot", "QakBot", "Dridex", "Ryuk", "LockBit")
ACTOR_NAMES = ("APT28", "APT29", "Lazarus", "Sandworm", "FIN7")

# Candidates of hosts and addresses, and what speaks for or against an indicator.
HOST_CANDIDATE = r"(?i)\b[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+\b"
HOST_DEFANGED = r"(?i)\b[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\[\.\][a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+\b"
NO_HOSTS = ("e.g.", "i.e.", "etc.", "vs.", "no.", "inc.", "ltd.", "corp.", "127.0.0.1", "localhost", "0.0.0.0", "255.255.255.255")
PACKAGE_STARTS = ("com.android.", "com.google.", "org.telegram.", "org.mozilla.", "org.thoughtcrime.", "net.openvpn.", "de.blinkt.", "eu.thedarken.", "vpn.fastvpn.")
PACKAGE_WORDS = ("app", "apps", "browser", "messenger", "providers", "android", "mobile", "skydrive", "dropbox", "microsoft", "google", "facebook", "amazon", "apple", "telegram", "mozilla", "skype")
NAME_SUFFIXES = (".key", ".csv", ".db", ".sh", ".rc", ".cfg", ".conf", ".ini", ".log", ".cache", ".tmp", ".bak", ".xml", ".json", ".txt", ".dat", ".pid", ".flag", ".html", ".css", ".js", ".index", ".new", ".payload")
NAME_WORDS = ("session", "android", "cached", "syscache", "sysinfo", "aid", "ndata")
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
PRIVATE = r"^10\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^127\."
DEFANG_MARKS = ("[.]", "[:]", "hxxp", "[victim]", "[domain]", "[ip]", "[host]")
THREAT_CONTEXT = ("indicator", "ioc", "indicators of compromise", "threat", "malicious", "compromise", "attack", "adversary", "campaign", "actor", "apt", "unc", "exploit", "c2", "command and control", "phishing", "malware")
TRUSTED_HOSTS = ("microsoft.com", "google.com", "amazon.com", "salesforce.com", "github.com", "stackoverflow.com", ".gov", ".edu", ".mil")
SUSPICIOUS = r"(?i)\d+\.\d+\.\d+\.\d+|[a-z0-9]{10,}\.com|\.tk$|\.ml$|\.ga$|\.cf$|[0-9]+-[0-9]+-[0-9]+"
PRODUCTS = (r"(?i)\b(microsoft\s+\w+)", r"(?i)\b(windows\s+[\w\s]*?\d+)", r"(?i)\b(adobe\s+\w+)", r"(?i)\b(oracle\s+\w+)", r"(?i)\b(apache\s+\w+)", r"(?i)\b(cisco\s+\w+)", r"(?i)\b(vmware\s+\w+)", r"(?i)\b(\w+\s+server)", r"(?i)\b(\w+\s+application)")

# Words in names of link parameters, near private addresses, and of text categories in the order in which they are tried.
LINK_WORDS = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "ref", "source", "campaign")
THREAT_NEAR = ("malware", "c2", "command", "control", "beacon", "callback", "threat", "attack", "compromise", "infrastructure")
CATEGORIES = (
    ("mitigation", ("out-of-band", "patch", "workaround", "mitigation")),
    ("observed_in_wild", ("exploited in the wild", "actively exploited")),
    ("ioc", ("ioc",)),
    ("exploit", ("exploit", "rce", "poc", "weaponized")),
)

# What registry keys do not hold.
REGISTRY_STOP = r"(?i)http|www|ftp://|\[\.\]|hxxp|javascript:|mailto:|file://|cmd\.exe|powershell\.exe|sc create|reg add|net start|net stop|&&|\|\||; |\n"
REGISTRY_ODD = r"(?i)\\\\|\\$|\s+\\|\\\s+|\s+(create|add|delete|query|start|stop)\s+|(sc|net|reg)\s+"

# Candidates of web addresses, and the older patterns for addresses and host names.
URL_CANDIDATES = (
    r"https?://[^\s<>\"]+",
    r"hxxps?://[^\s<>\"]+",
    r"https?\[:\]//[^\s<>\"]+",
    r"https?://[^\s<>\"]*\[?\.\]?[^\s<>\"]*",
    r"[a-zA-Z0-9.-]+\[\.\][a-zA-Z0-9.-]+\[\.\][a-zA-Z]{2,}(?:/[^\s<>\"]*)?",
    r"\b(?:\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})/[^\s<>\"]+",
    r"\b[Ll]ogin[^\s<>\"]*\.[a-zA-Z0-9.-]+(?:/[^\s<>\"]*)?",
)
_FOUR = r"[0-9]{1,3}(?:\[\.\])[0-9]{1,3}(?:\[\.\])[0-9]{1,3}(?:\[\.\])[0-9]{1,3}"
_MIXED = r"[0-9]{1,3}(?:\.|\[\.\])[0-9]{1,3}(?:\.|\[\.\])[0-9]{1,3}(?:\.|\[\.\])[0-9]{1,3}"
_PORT_PATH = r"(?::[0-9]+)?(?:/[^\s<>\"'`,]*)?"
_QUERY = r"(?:\?[^\s<>\"'`,]*)?"
LEGACY_URLS = (
    r"(?i)https?://[^\s<>\"'`]+",
    r"(?i)https?\[:\]//[^\s<>\"'`]+",
    r"(?i)hxxps?\[:\]//[^\s<>\"'`]+",
    r"(?i)https?://" + _FOUR + _PORT_PATH,
    r"(?i)hxxps?://" + _FOUR + _PORT_PATH,
    r"(?i)https?://" + _MIXED + _PORT_PATH,
    r"(?i)hxxps?://" + _MIXED + _PORT_PATH,
    r"(?i)https?://[a-zA-Z0-9-]+(?:\[\.\])[a-zA-Z0-9-]+(?:\[\.\])[a-zA-Z]{2,}" + _PORT_PATH + _QUERY,
    r"(?i)hxxps?://[a-zA-Z0-9-]+(?:\[\.\])[a-zA-Z0-9-]+(?:\[\.\])[a-zA-Z]{2,}" + _PORT_PATH + _QUERY,
    r"(?i)[a-zA-Z0-9-]+(?:\[\.\][a-zA-Z0-9-]+){1,}\[\.\][a-zA-Z]{2,}" + _PORT_PATH + _QUERY,
    r"(?i)https?://[a-zA-Z0-9-]+\[[a-zA-Z0-9_-]+\]\.[a-zA-Z0-9-.]+" + _PORT_PATH + _QUERY,
    r"(?i)[a-zA-Z0-9-]+(?:\.|\[\.\])[a-zA-Z0-9-]+(?:\.|\[\.\])[a-zA-Z0-9-]+(?:\.|\[\.\])*[a-zA-Z]{2,}" + _PORT_PATH + _QUERY + r"(?=.*\[\.\])",
    r"(?i)(?:www\.)?[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?::[0-9]+)?(?:/[^\s<>\"'`,]+|\?[^\s<>\"'`,]+)",
    r"(?i)(?:www\.)?[a-zA-Z0-9-]+\.[a-zA-Z]{2,}(?::[0-9]+)?(?:/[^\s<>\"'`,]+|\?[^\s<>\"'`,]+)",
    r"(?i)[a-zA-Z0-9-]+\.(?:tk|ml|ga|cf|bit|onion)(?::[0-9]+)?(?!\S)",
    r"(?i)[a-zA-Z0-9-]+(?:\[\.\][a-zA-Z0-9-]+)+\[\.\][a-zA-Z]{2,}(?::[0-9]+)?(?!\S)",
)
LEGACY_DOMAINS = (
    r"\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?![/\?\s]*[^\s])",
    r"\b(?:[a-zA-Z0-9-]+\[\.\])+[a-zA-Z]{2,}(?![/\?\s]*[^\s])",
    r"\b[a-zA-Z0-9-]+(?:\[\.\][a-zA-Z0-9-]+)+\[\.\][a-zA-Z]{2,}(?![/\?\s]*[^\s])",
    r"\b[a-zA-Z0-9-]+\[\.\][a-zA-Z0-9.-]+(?![/\?\s]*[^\s])",
)
PAGE_SUFFIXES = ("php", "html", "htm", "asp", "jsp", "js", "css", "txt", "xml", "json")
IPV6 = (r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", r"\b(?:[0-9a-fA-F]{1,4}:){1,6}::[0-9a-fA-F]{0,4}\b")
PRIVATE_WIDE = r"^10\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^127\.|^169\.254\.|^224\.|^0\.|^255\.255\.255\.255$"
REPORT_WORDS = ("indicators", "iocs", "malicious", "threat actor", "compromise")

# Prices of a thousand tokens in and out by a part of the model's name (the first that fits; others cost as the first).
MODEL_PRICES = (("gpt-4o-mini", 0.00015, 0.0006), ("gpt-4o", 0.005, 0.015), ("gpt-4-turbo", 0.01, 0.03), ("gpt-3.5-turbo", 0.0005, 0.0015))
# Token limits of agents and the settings that change them.
TOKEN_LIMITS = {"summarize": 3500, "entity": 4000, "ioc": 3500, "cve": 3500, "mitre": 3500, "geo_motivation": 3500, "cyber": 3000, "general": 3500}
TOKEN_SETTINGS = {
    "summarize": "LLM_SUMMARIZE_MAX_TOKENS", "entity": "LLM_ENTITY_MAX_TOKENS", "ioc": "LLM_IOC_MAX_TOKENS", "cve": "LLM_CVE_MAX_TOKENS",
    "mitre": "LLM_MITRE_MAX_TOKENS", "geo_motivation": "LLM_GEO_MOTIVATION_MAX_TOKENS", "cyber": "LLM_CYBER_MAX_TOKENS", "general": "LLM_DEFAULT_MAX_TOKENS",
}

# Lines that a cut keeps first, what stands between chunks and for none, headers of printed pages, words of advice.
PRIORITY_LINE = r"\bCVE-\d{4}-\d+\b|(?i:\b(?:APT|UNC)\d+\b)|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b|\b[a-fA-F0-9]{32,64}\b|https?://[^\s]+"
CHUNK_SEPARATOR = "\n\n--- CHUNK SEPARATOR ---\n\n"
NO_RELEVANT = "No cybersecurity-relevant content found in the document."
PDF_HEADER = r"^[A-Z][A-Z\s]{2,}$|^\d+\.\s+[A-Z]|^(?:CHAPTER|SECTION|PART)\s+\d+|^(?:ABSTRACT|INTRODUCTION|BACKGROUND|METHODOLOGY|RESULTS|DISCUSSION|CONCLUSION)"
ADVICE = r"(?i)\b(?:apply|update|upgrade|patch|disable|enable|block|monitor|restrict|isolate|rotate|reset|review|install|recommend(?:ed|s)?|should|must)\b"
# Stages of an attack, levels of tension and escalation, motives beyond the rules', words that name no entity.
KILL_CHAIN = ("initial_access", "execution", "persistence", "defense_evasion", "credential_access", "discovery", "lateral_movement", "collection", "command_control", "exfiltration", "impact")
TENSION_LEVELS = ("low", "medium", "high", "critical")
ESCALATION_LEVELS = ("low", "medium", "high")
MOTIVES = ("financial", "espionage", "hacktivism", "extortion", "sabotage", "destabilization", "unknown")
NO_ENTITIES = ("malware", "ransomware", "trojan", "backdoor", "attacker", "attackers", "threat actor", "threat actors", "hackers", "users", "organizations", "companies", "system", "software", "unknown")
# Words of keys that a cut of flattened JSON keeps first, and keys that tell what a JSON text is about.
IMPORTANT_KEYS = ("title", "name", "type", "id", "description", "summary", "url", "link", "date", "time", "value", "content")
KEY_FIELDS = ("title", "name", "subject", "info", "description", "summary", "message", "content", "data")

# Indicator pattern lines and the values in them.
STIX_BODY = r"STIX_INDICATOR_PATTERN:\s*\[([^\]]+)\]"
STIX_VALUES = {
    "domain": r"domain-name:value\s*=\s*'([^']+)'", "ipv4": r"ipv4-addr:value\s*=\s*'([^']+)'", "ipv6": r"ipv6-addr:value\s*=\s*'([^']+)'", "url": r"url:value\s*=\s*'([^']+)'",
    "md5": r"file:hashes\.'?MD5'?\s*=\s*'([^']+)'", "sha1": r"file:hashes\.'?SHA-1'?\s*=\s*'([^']+)'", "sha256": r"file:hashes\.'?SHA-256'?\s*=\s*'([^']+)'", "sha512": r"file:hashes\.'?SHA-512'?\s*=\s*'([^']+)'",
    "excluded": r"(?:x509-certificate:serial_number|ethernet-addr:value)\s*=\s*'([^']+)'",
}
