"""Patterns, tokens, codes and messages that must be equal for equal results.

Everything in this file is data, written in the Python regex dialect and in natural order.
"""

from __future__ import annotations

from typing import NamedTuple

# ---------------------------------------------------------------------------------------------------------------------
# Actions, codes, scopes, services
# ---------------------------------------------------------------------------------------------------------------------
ALLOW, BLOCK, MASKING, ACCEPT = "allow", "block", "masking", "accept"
CODE_ALLOW, CODE_BLOCK, CODE_MASKING = 0, 1, 2
SCOPES = ("user", "service", "group", "default")
SERVICE_NAMES = {0: "unknown", 1: "gpt", 2: "gemini", 3: "claude", 4: "grok",
                 10: "openapi.copilot", 11: "cursor.ai", 12: "claude.code"}
AUDIT_INDEXES = ("input_filter", "regex_filter", "output_filter", "llm_filter")
DEFAULT_FILTERS = ("input_filter", "secret_filter", "slm_filter")

# ---------------------------------------------------------------------------------------------------------------------
# Personal data patterns
# ---------------------------------------------------------------------------------------------------------------------
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?=$|\s|[<>,;:)\]]|[^\x00-\x7F])"
KR_MOBILE = r"\b01[016789]-?\d{3,4}-?\d{4}\b"
KR_PHONE = r"\b0\d{1,2}-\d{3,4}-\d{4}\b"
CARD = r"\b(?:\d[ -]*?){13,19}\b"
KR_RRN = r"\b(\d{2})(\d{2})(\d{2})-?([1-4])(\d{6})\b"
PASSPORT = r"(?i)\b[MSR]\d{8}\b"
IP = r"(?i)\b(?:(?:\d{1,3}\.){3}\d{1,3}|(?:[A-F0-9]{1,4}:){7}[A-F0-9]{1,4})\b"
DRIVER_LICENSE = r"\b\d{2}-?\d{2}-?\d{6}(?:-\d{2})?\b"
FOREIGN_RRN = r"\b(\d{2})(\d{2})(\d{2})-?([5-8])(\d{6})\b"
BUSINESS_REG = r"\b\d{3}-\d{2}-\d{5}\b"
HEALTH_INSURANCE = r"(?i)(?:건강보험(?:증|번호)?[:\s\-]*|NHIS[:\s\-]*)[A-Za-z0-9\-]{6,20}"
TAX_INFO = r"(?i)(?:\bTIN\b|\bTax ID\b|납세자번호|세금번호)[:\s\-]*[0-9\-]{5,20}"
EIN = r"\b\d{2}-\d{7}\b"
MILITARY_ID = r"\b\d{2}-\d{8}\b"

_PROVINCE = r"[가-힣]{2,}(?:특별시|광역시|특별자치시|시|도|군|구)\s+[가-힣0-9\s]*(?:구|시|군)\s+"
ADDRESS_STREET = _PROVINCE + r"[가-힣0-9\s]*(?:로|길)\s+\d+(?:-\d+)?(?:\s*,?\s*\d+층|동|호)?"
ADDRESS_LOT = _PROVINCE + r"[가-힣]+동\s+\d+(?:-\d+)?(?:번지|번)"
ADDRESS_ROAD = f"(?:{ADDRESS_STREET}|{ADDRESS_LOT})"
ADDRESS_POSTAL = r"(?:\(?\d{5}\)?\s*)" + _PROVINCE + r"[가-힣0-9\s\-,]*(?:\d+(?:-\d+)?(?:번지|번|호|층)?)"
ADDRESS_SIMPLE = (
    r"(?:서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충북|충남|전북|전남|경북|경남|제주)"
    r"(?:특별시|광역시|특별자치시|시|도)?\s+[가-힣]+(?:구|시|군)\s+[가-힣0-9\s]*(?:로|길|동)\s*\d+")
ADDRESS_BUILDING = (
    _PROVINCE + r"[가-힣]+동\s+\d+(?:-\d+)?\s+[가-힣0-9\s]*(?:아파트|빌딩|타워|오피스텔|빌라|주택|상가)\s*"
    r"(?:\d+동\s*)?(?:\d+호)?")

# Literal a text must hold (or cheap pattern it must match) before the full pattern is tried.
NEEDS_AT, NEEDS_DASH, NEEDS_01 = "@", "-", "01"
GATE_DIGITS13 = r"\d{6}-?\d{7}"
GATE_DIGIT_RUN = r"\d{8}"
GATE_IP = r"\d\.\d|[0-9A-Fa-f]:[0-9A-Fa-f]"
GATE_ROAD_NUMBER = r"[가-힣][\s\-,]*\d"


class PiiPattern(NamedTuple):
    type: str
    pattern: str
    literal: str | None = None
    gate: str | None = None


# Order of detection, which is also the order of types in a result.
PII_DETECTION = (
    PiiPattern("email", EMAIL, literal=NEEDS_AT),
    PiiPattern("phone", KR_MOBILE, literal=NEEDS_01),
    PiiPattern("phone", KR_PHONE, literal=NEEDS_DASH),
    PiiPattern("passport", PASSPORT, gate=GATE_DIGIT_RUN),
    PiiPattern("kr_rrn", KR_RRN, gate=GATE_DIGITS13),
    PiiPattern("ip", IP, gate=GATE_IP),
    PiiPattern("driver_license", DRIVER_LICENSE),
    PiiPattern("foreign_rrn", FOREIGN_RRN, gate=GATE_DIGITS13),
    PiiPattern("business_reg", BUSINESS_REG, literal=NEEDS_DASH),
    PiiPattern("health_insurance", HEALTH_INSURANCE),
    PiiPattern("tax_info", TAX_INFO),
    PiiPattern("ein", EIN, literal=NEEDS_DASH),
    PiiPattern("military_id", MILITARY_ID, literal=NEEDS_DASH),
    PiiPattern("address", ADDRESS_ROAD, gate=GATE_ROAD_NUMBER),
    PiiPattern("address", ADDRESS_POSTAL, gate=GATE_ROAD_NUMBER),
    PiiPattern("address", ADDRESS_SIMPLE, gate=GATE_ROAD_NUMBER),
    PiiPattern("address", ADDRESS_BUILDING, gate=GATE_ROAD_NUMBER),
)
CARD_TYPES = ("credit_card", "credit_card_candidate")

# Order of redaction: the widest pattern, the card candidate, comes last.
PII_REDACTION = (
    ("email", EMAIL), ("phone", KR_MOBILE), ("phone", KR_PHONE), ("kr_rrn", KR_RRN), ("passport", PASSPORT), ("ip", IP),
    ("driver_license", DRIVER_LICENSE), ("foreign_rrn", FOREIGN_RRN), ("business_reg", BUSINESS_REG),
    ("health_insurance", HEALTH_INSURANCE), ("tax_info", TAX_INFO), ("ein", EIN), ("military_id", MILITARY_ID),
    ("address", ADDRESS_ROAD), ("address", ADDRESS_POSTAL), ("address", ADDRESS_SIMPLE), ("address", ADDRESS_BUILDING),
    ("credit_card", CARD),
)

# Redaction tokens
PII_TOKENS = {
    "email": "[이메일]", "phone": "[전화번호]", "credit_card": "[신용카드번호]", "credit_card_candidate": "[개인정보]",
    "kr_rrn": "[주민등록번호]", "passport": "[여권번호]", "ip": "[IP주소]", "driver_license": "[운전면허번호]",
    "foreign_rrn": "[외국인등록번호]", "business_reg": "[사업자등록번호]", "health_insurance": "[건강보험번호]",
    "tax_info": "[세금정보]", "ein": "[세금정보]", "address": "[주소]", "military_id": "[군번]",
}
PII_TOKEN_OTHER = "[개인정보]"

# Types that count as hits by default; ``ein`` is detected and redacted with ``tax_info`` but is no hit of its own.
PII_ENABLED = ("email", "phone", "ip", "kr_rrn", "passport", "credit_card", "credit_card_candidate", "driver_license",
               "foreign_rrn", "business_reg", "health_insurance", "tax_info", "address", "military_id")

# ---------------------------------------------------------------------------------------------------------------------
# Obfuscated personal data
# ---------------------------------------------------------------------------------------------------------------------
# The e-mail and number patterns have no cased letters, so they need no case flag, which would slow them down.
DOT_WORDS = r"(?:점|닷|도트|\.)"
DOT_WORD_LIST = ("점", "닷", "도트")
OBFUSCATED_EMAIL = r"\b[\w.+-]{1,64}\s*@\s*(?:[\w-]{1,63}(?:점|닷|도트|\.)){1,4}[\w-]{2,24}\b"
NUMBER_BLOCK = r"(?:\+?82\s*[-.\s]?)?(?:\(?0\d{1,2}\)?[-.\s]?)?[\d공영일이삼사오육륙칠팔구\s\-\.·]{7,}"
BANK_WORDS = r"(?i)(은행|bank|계좌|account|카드|card|통장|송금)"
PHONE_HINT = r"(\+?82|0\d{1,2})"
HANGUL_NUMERALS = "공영일이삼사오육륙칠팔구"
ASCII_NUMERALS = "001234566789"
CONTEXT_CHARS = 16
OBFUSCATED_ADDRESSES = (ADDRESS_STREET, ADDRESS_LOT, ADDRESS_POSTAL, ADDRESS_SIMPLE, ADDRESS_BUILDING)
MASK_TOKEN = "[MASKING]"

# ---------------------------------------------------------------------------------------------------------------------
# secrets
# ---------------------------------------------------------------------------------------------------------------------
PEM_BLOCK = r"-----BEGIN (?P<K>[^-\r\n]+?) KEY-----[\s\S]+?-----END (?P=K) KEY-----"
JWT = r"\b[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"
_KEY_WORDS = r"(?:api[_-]?key|x-api-key|api[_-]?token|x-api-token|auth[_-]?token|password|secret)"
KNOWN_TOKENS = (
    ("google_api_key", r"\b(?P<VAL>AIza[0-9A-Za-z_\-]{35})\b"),
    ("github_token", r"\b(?P<VAL>(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,255})\b"),
    ("slack_token", r"\b(?P<VAL>xox[abprs]-[A-Za-z0-9-]{10,})\b"),
    ("discord_token", r"\b(?P<VAL>[MN][A-Za-z\d]{23}\.[\w-]{6}\.[\w-]{27})\b"),
    ("discord_like", r"\b(?P<VAL>DISCORD[_-]TOKEN[_A-Za-z0-9\-]*)\b"),
    ("stripe_key", r"\b(?P<VAL>sk_(?:live|test)_[A-Za-z0-9]{16,})\b"),
    ("twilio_api", r"\b(?P<VAL>SK[0-9a-fA-F]{32})\b"),
    ("sendgrid_api", r"\b(?P<VAL>SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{20,})\b"),
    ("aws_access_key_id", r"\b(?P<VAL>(?:AKIA|ASIA|ANPA|ABIA)[0-9A-Z]{16})\b"),
    ("aws_secret_access_key", r"(?<![A-Za-z0-9/+=])(?P<VAL>[A-Za-z0-9/+=]{40})(?![A-Za-z0-9/+=])"),
    ("openai_like", r"\b(?P<VAL>sk-[A-Za-z0-9]{16,})\b"),
    ("kv_quoted", r"(?i)\b" + _KEY_WORDS + r"\b\s*[:=]\s*[\"'](?P<VAL>[^\"\r\n]{6,})[\"']"),
    ("kv_bare", r"(?i)\b" + _KEY_WORDS + r"\b\s*[:=]\s*(?P<VAL>[^\s\"'`]{8,})"),
)
ENTROPY_CANDIDATE = r"[A-Za-z0-9+/=._\-]{20,}"
BASE64_SHAPE = r"^[A-Za-z0-9+/=]+$"
HEX_SHAPE = r"^[A-Fa-f0-9]+$"
# shape: (minimum length, minimum entropy in bits)
ENTROPY_LIMITS = {"base64": (24, 4.3), "hex": (32, 3.2), "mixed": (24, 4.0)}
SAMPLE_CHARS = 30

# (name, rule, action, numeric flags, named group or None)
CLOUD_RULES = (
    ("PEM 패턴", PEM_BLOCK, "block", 16, None),
    ("JWT", r"\b[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", "masking", 0, None),
    ("aws_access_key_id", r"\b(?:AKIA|ASIA|ANPA|ABIA)[0-9A-Z]{16}\b", "block", 0, None),
    ("aws_secret_access_key", r"(?<![A-Za-z0-9/+=])([A-Za-z0-9/+=]{40})(?![A-Za-z0-9/+=])", "masking", 0, None),
    ("azure_storage_account_key", r"(?i)\bAccountKey=(?P<VAL>[A-Za-z0-9+/=]{30,})", "block", 0, "VAL"),
    ("azure_conn_string",
     r"(?i)\bDefaultEndpointsProtocol=\w+;AccountName=\w+;AccountKey=(?P<VAL>[A-Za-z0-9+/=]{30,})",
     "masking", 0, "VAL"),
    ("basic_auth_creds", r"(?i)\b(?:https?|ftp|ssh)://(?P<CREDS>[^:@\s/]+:[^@\s/]+)@", "block", 0, "CREDS"),
    ("cloudant_creds", r"(?i)https?://(?P<CREDS>[^:@\s/]+:[^@\s/]+)@[^/\s]*\.cloudant\.com", "masking", 0, "CREDS"),
    ("discord_bot_token", r"\b(?P<VAL>[MN][A-Za-z\d]{23}\.[\w-]{6}\.[\w-]{27})\b", "block", 0, "VAL"),
    ("github_token", r"\b(?P<VAL>(?:ghp|gho|ghu|ghs|ghr)[-_][A-Za-z0-9]{16,})\b", "masking", 0, "VAL"),
    ("mailchimp_api_key", r"\b(?P<VAL>[0-9a-f]{32}-us\d{1,2})\b", "block", 0, "VAL"),
    ("slack_token", r"\b(?P<VAL>xox[abprs]-[A-Za-z0-9-]{10,})\b", "masking", 0, "VAL"),
    ("slack_webhook_path",
     r"(?i)https://hooks\.slack\.com/services/(?P<VAL>T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+)", "block", 0, "VAL"),
    ("stripe_secret", r"\b(?P<VAL>sk_(?:live|test)_[A-Za-z0-9]{16,})\b", "masking", 0, "VAL"),
    ("stripe_publishable", r"\b(?P<VAL>pk_(?:live|test)_[A-Za-z0-9]{16,})\b", "block", 0, "VAL"),
    ("twilio_account_sid", r"\b(?P<VAL>AC[0-9a-fA-F]{32})\b", "masking", 0, "VAL"),
    ("twilio_auth_token", r"(?<![A-Za-z0-9])(?P<VAL>[0-9a-fA-F]{32})(?![A-Za-z0-9])", "block", 0, "VAL"),
    ("openai_like", r"\b(?P<VAL>sk-[A-Za-z0-9]{16,})\b", "masking", 0, "VAL"),
    ("ak_tk_token", r"\b(?P<VAL>(?:ak|tk)-[a-f0-9]{16,}(?:-(?:dev|test)[a-z0-9]*)?)\b", "block", 0, "VAL"),
    ("candidate", r"[A-Za-z0-9+/=._\-]{16,}", "masking", 0, None),
)

# ---------------------------------------------------------------------------------------------------------------------
# Code blocks, files
# ---------------------------------------------------------------------------------------------------------------------
FENCED_CODE = r"(?s)```(\w+)?\n(.*?)```"
FENCED_CODE_STRICT = r"(?s)```(?P<lang>[a-zA-Z0-9_\-\+\.#]*)\n(?P<code>.*?)(?:```)"
CODE_DEFAULT_LANGUAGE = "plaintext"
RISKY_CODE = (r"exec\(", r"eval\(", r"os\.system", r"subprocess", r"socket", r"requests", r"open\(")

MIME_EXTENSIONS = {
    "application/msword": "doc",
    "application/octet-stream": "docx",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/x-hwp": "hwp",
    "application/zip": "hwpx",
    "application/pdf": "pdf",
}
UNKNOWN_EXTENSION = "unknown"
ALLOWED_EXTENSIONS = ("doc", "docx", "hwp", "hwpx", "pdf")
MAX_FILE_SIZE = 10_000_000
REASON_EXTENSION = "not allowed file extension"
REASON_SIZE = "fize size exceeds limit"
CHUNK_CHARS = 256

# ---------------------------------------------------------------------------------------------------------------------
# Texts shown to people or to the model
# ---------------------------------------------------------------------------------------------------------------------
BLOCKED_PLACEHOLDER = "[BLOCKED BY REGEX FILTER]"
NOTICE_HEADER = "개인정보유출 경고메세지를 맨앞에 추가해주세요"
NOTICE_TYPES = "탐지 유형"
NOTICE_SAMPLES = "마스킹"
LANGUAGE_PROMPT = "다음 지침을 엄격히 따르세요: 모든 답변은 한국어로만 작성하세요. 영어/혼용 금지."
LANGUAGE_MARKER = "한국어"
MODEL_BLOCK_GUIDE = "요청이 정책에 의해 제한되었습니다. 한줄로 차단 안내 메세지를 작성해주세요"
MODEL_BLOCK_CAUSE = "차단 원인"
MODEL_BLOCK_IDS = "참고"
MASKED_LINES_LABEL = "마스킹된 라인"
RULE_BLOCK_LEAD = "다음 문장을 사용자에게 그대로 출력하세요(추가 설명/수정/확장/사과문 금지):"
RULE_BLOCK_NOTICE = "차단되었습니다."
REPORT_EMPTY = "> 검사 결과 없음"
REPORT_COLUMNS = "| # | 언어 | 결정 | 점수 | 이유 |"
REPORT_RULE = "|---:|:----|:-----|:----:|:-----|"
