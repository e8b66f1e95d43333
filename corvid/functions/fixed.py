"""The lists, tables and limits that results must agree on."""

# --- corpus rules (fixed values) ---
MIN_CHARS, MIN_WORDS, MAX_CHARS = 40, 5, 200_000
PLACEHOLDER_TEXTS = ["", "empty", "nan", "none", "null", "no content", "no text"]
LEGITIMATE_LABELS = ["0", "benign", "ham", "legit", "legitimate", "non phishing", "not phishing", "safe", "safe email"]
PHISHING_LABELS = ["1", "fraud", "fraudulent", "malicious", "phish", "phishing", "phishing email", "scam", "spam"]
SYNTHETIC_PREFIX, SYNTHETIC_SOURCES = "synthetic_", ["kaggle_phishing_and_legitimate_emails"]
DISALLOWED_SOURCES, LEGACY_SOURCES = ["ubuntu_modern_ham"], ["kaggle", "kaggle_subhajournal_phishingemails"]
FORCED_SPLITS = {"spaphish_train": "train", "spaphish_validation": "validation", "spaphish_test": "test", "zenodo_validation_2024": "validation"}
MAX_SYNTHETIC_SHARE, CAMPAIGN_COSINE = 0.10, 0.83

# --- analysis limits (fixed values) ---
MAX_FILE_BYTES, MAX_PARTS, MAX_DEPTH, MAX_TEXT, MAX_MODEL_TEXT, MAX_ATTACHMENTS, MAX_LINKS, MAX_HOPS = 10 << 20, 200, 10, 240_000, 120_000, 25, 100, 50

# --- mail headers (fixed values) ---
NO_REPLY_LOCALS = ["no-reply", "noreply", "do-not-reply", "donotreply", "notification", "notifications", "newsletter", "news", "mail", "mailer"]
GENERIC_REPLY_LOCALS = ["support", "help", "helpdesk", "contact", "contacts", "info", "assistenza", "assistance", "customer", "customerservice", "customer-service", "service", "reply", "replies"]
BULK_HEADERS = [
    "List-Unsubscribe", "List-Unsubscribe-Post", "List-Id", "List-Help", "List-Owner", "List-Post", "List-Subscribe", "Precedence", "Auto-Submitted", "X-Mailer",
    "X-Campaign", "X-Campaign-Id", "X-Mailgun-Tag", "X-Mailgun-Sid", "X-MC-User", "X-Mandrill-User", "X-SES-Outgoing", "X-SFDC-LK", "X-SG-EID", "X-SMTPAPI",
]
BULK_SIGNALS = 4
AUTH_PRIORITY = {"fail": 100, "permerror": 95, "temperror": 90, "softfail": 85, "policy": 80, "neutral": 70, "none": 60, "unknown": 50, "bestguesspass": 10, "pass": 0}

# --- lookalike domains (fixed values) ---
BRANDS = [
    "paypal.com", "amazon.com", "amazon.it", "apple.com", "microsoft.com", "google.com", "gmail.com", "outlook.com", "live.com", "hotmail.com",
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "dropbox.com", "icloud.com", "chase.com", "wellsfargo.com", "bankofamerica.com",
    "intesasanpaolo.com", "unicredit.it", "poste.it", "postepay.it", "netflix.com", "spotify.com", "ebay.com", "dhl.com", "fedex.com", "ups.com", "brt.it", "gls-italy.com",
]
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "ԁ": "d", "ı": "i", "ĺ": "l", "ḷ": "l", "ɡ": "g", "ʏ": "y", "ʋ": "v"}
DECEPTIVE_PREFIXES = ["secure-", "login-", "verify-", "account-", "update-", "signin-", "support-", "my-", "auth-"]

# --- attachments (fixed values): format and its signatures, in the order in which they are tried ---
MAGIC = [
    ("pdf", [b"%PDF"]), ("zip", [b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"]), ("exe", [b"MZ"]), ("elf", [b"\x7fELF"]), ("png", [b"\x89PNG\r\n\x1a\n"]), ("jpg", [b"\xff\xd8\xff"]),
    ("gif", [b"GIF87a", b"GIF89a"]), ("bmp", [b"BM"]), ("tiff", [b"II*\x00", b"MM\x00*"]), ("rar", [b"Rar!\x1a\x07"]), ("7z", [b"7z\xbc\xaf\x27\x1c"]), ("gz", [b"\x1f\x8b"]), ("bz2", [b"BZh"]),
    ("doc", [b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"]), ("rtf", [b"{\\rtf"]), ("html", [b"<!DOCTYPE", b"<html"]), ("xml", [b"<?xml"]), ("sh", [b"#!/"]),
]
CONTENT_TYPES = {
    "application/pdf": ["pdf"], "application/zip": ["zip", "docx", "xlsx", "pptx"], "application/msword": ["doc"],
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ["docx"], "application/vnd.ms-excel": ["xls"],
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ["xlsx"], "application/vnd.ms-powerpoint": ["ppt"],
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ["pptx"], "application/x-rar-compressed": ["rar"], "application/x-7z-compressed": ["7z"],
    "application/gzip": ["gz"], "application/x-bzip2": ["bz2"], "application/octet-stream": [], "image/png": ["png"], "image/jpeg": ["jpg"], "image/gif": ["gif"], "image/bmp": ["bmp"],
    "image/tiff": ["tiff"], "text/html": ["html"], "text/xml": ["xml"], "application/rtf": ["rtf"],
}

# --- text patterns (fixed values), Java syntax ---
PLACEHOLDERS = [
    (r"(?iU)(?<!\w)(?:https?://|ftp://|www\.)[^\s<>\"']+|(?<!\w)mailto:[^\s<>\"']+", "[URL LINK]"),
    (r"(?U)\b(?:[A-Za-z0-9._%+-]+)@(?:[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", "[EMAIL ADDRESS]"),
    (r"(?iU)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "[IBAN]"),
    (r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP ADDRESS]"),
    (r"(?U)\b(?:\d[ -]?){13,19}\b", "[CARD OR ACCOUNT NUMBER]"),
    (r"(?U)(?<!\w)\+?\d[\d .()/-]{7,}\d\b", "[PHONE NUMBER]"),
    (r"(?<![A-Za-z0-9@_+=./-])[A-Za-z0-9][A-Za-z0-9@_+=./-]{159,}(?![A-Za-z0-9@_+=./-])", "[OBFUSCATED DATA]"),
]
FORWARD_MARKER = r"(?i)^\s*(?:-{2,}\s*forwarded message\s*-{2,}|begin forwarded message:|forwarded message|messaggio inoltrato|inizio messaggio inoltrato)\s*$"
REPLY_MARKER = r"(?i)^\s*(?:on .+ wrote:|il giorno .+ ha scritto:|le .+ a ecrit\s*:|am .+ schrieb .+:|-{2,}\s*original message\s*-{2,}|-{2,}\s*messaggio originale\s*-{2,})\s*$"
FORWARDED_HEADER = r"(?i)^\s*(?:from|da|de|sent|inviato|date|data|to|a|cc|bcc|subject|oggetto)\s*:"
REPLY_FROM = r"(?i)^\s*(?:from|da|de)\s*:"
REPLY_HEADER = r"(?i)^\s*(?:sent|inviato|date|data|to|a|cc|bcc|subject|oggetto)\s*:"
SEPARATOR = r"^\s*[_=*-]{10,}\s*$"
BOILERPLATE_LINE = (
    r"(?i)^\s*(?:please consider the impact on the environment before printing|this e-?mail may contain|this message may contain|this e-?mail was sent to you by|legal disclosure\b|privacy statement\b|"
    r"if you no longer wish to receive|to opt out of future communications|if you'd like me to stop sending you emails|if you would like me to stop sending you emails|unsubscribe\b|informativa privacy\b|riservatezza\b|avvertenza di riservatezza\b|nota di riservatezza\b)"
)
SIGN_OFF = r"(?i)^\s*(?:cordiali saluti|distinti saluti|un saluto|saluti|best regards|kind regards|regards|thanks|thank you|good luck|sincerely|cheers)\s*,?\s*$"
ANONYMOUS = [
    (r"(?U)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "[IBAN]"),
    (r"(?U)(?<!\w)\+?\d[\d .()/-]{7,}\d\b", "[PHONE]"),
    (r"(?U)\b(?:\d[ -]?){13,19}\b", "[POSSIBLE_CARD_OR_ACCOUNT]"),
    (r"(?U)\b(?:[A-Za-z0-9._%+-]+)@(?:[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", "[EMAIL ADDRESS]"),
    (r"\bhttps?://[^\s<>\"]+", "[URL LINK]"),
    (r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP ADDRESS]"),
    (r"(?iU)\b(Ciao|Gentile|Buongiorno|Buonasera|Salve)\s+\p{L}[\p{L}\p{N}_' -]{2,}", "$1 [PERSON]"),
    (r"(?iU)\b(Sig\.?|Sig\.ra|Dott\.?|Dott\.ssa|Mr\.?|Mrs\.?|Ms\.?)\s+\p{L}[\p{L}\p{N}_' -]{2,}", "$1 [PERSON]"),
]

# --- context and reports (fixed values) ---
PASSIVE_ROLES = ["signature", "unsubscribe", "navigation"]
SCAM_RANKS = {"none": 0, "other": 1, "extortion": 2, "sextortion": 3}
THREAT_RANKS = {"none": 0, "other": 1, "data_exposure": 2, "reputation_harm": 2, "private_material_exposure": 3}
MAX_PDF_BYTES, MAX_REDIRECTS = 25 << 20, 5
REASON_WORDS = {
    "sender authentication passed": "the sender is authenticated",
    "sender authentication is incomplete or unavailable": "sender authentication is incomplete",
    "DKIM signature is absent": "the message has no DKIM signature",
    "Return-Path differs from the visible sender domain": "the Return-Path differs from the visible sender",
    "Reply-To differs unexpectedly from the sender identity": "the Reply-To differs from the sender",
    "display-name spoofing was detected": "possible display-name spoofing was detected",
    "a URL is detected as malicious": "a URL was detected as malicious",
    "a URL has suspicious reputation": "a URL has a suspicious reputation",
    "an attachment is detected as malicious": "an attachment was detected as malicious",
    "an attachment has suspicious reputation": "an attachment has a suspicious reputation",
    "an attached PDF contains high-risk active features": "a PDF contains high-risk active features",
    "an attachment has a structural or content anomaly": "an attachment contains anomalies",
    "a sender domain resolves to an IP with malicious reputation": "the sender domain resolves to an IP with malicious reputation",
    "a sender domain resolves to an IP with suspicious reputation": "the sender domain resolves to an IP with suspicious reputation",
    "the message contains a direct-IP URL": "the message contains a direct-IP link",
    "a lookalike or deceptive domain was detected": "a deceptive or lookalike domain was detected",
    "a sensitive account-verification link uses a domain unrelated to the sender": "the account-verification link uses a domain unrelated to the sender",
    "no strong technical threat was detected": "no confirmed technical threat was detected",
}
ACTION_WORDS = {
    "claim_reward": "contain a reward or promotional benefit and ask the recipient to claim it, a pattern commonly used in phishing",
    "pay_or_transfer": "contain a payment or money-transfer request, which can be used for financial phishing",
    "provide_credentials": "ask the recipient to provide credentials, a strong phishing pattern",
    "provide_information": "ask the recipient to submit personal information",
    "change_account_settings": "request account changes, an action that can expose the recipient to account takeover",
    "verify_account": "claim an account-security issue and ask the recipient to respond through a supplied channel, a common phishing pattern",
    "open_attachment": "ask the recipient to open an attachment, which may deliver malicious content",
    "visit_link": "ask the recipient to follow a supplied link",
    "reply": "ask the recipient to reply, without presenting another clearly identified risky action",
    "bypass_procedure": "ask the recipient to bypass normal procedures, a strong social-engineering indicator",
    "informational": "provide information without a clearly identified risky request",
    "none": "do not contain a clearly identified request",
    "other": "contain a request whose security implications could not be classified precisely",
}
