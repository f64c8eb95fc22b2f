"""Patterns in the dialect of Java's regular expressions; character classes are ASCII where results must agree with other engines."""

# Formats that are recognised.
MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
PRESENT = r"(?:present|current|now|ongoing|till\s*date|to\s*date|today)"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?(\d{1,3})[\s.\-()]?)?(?:\(?\d{2,4}\)?[\s.\-]?)?\d{3,4}[\s.\-]?\d{3,4}(?:[\s.\-]?\d{1,4})?"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/([a-zA-Z0-9\-_%]+)/?"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/([a-zA-Z0-9\-_%]+)/?"
WEBSITE = r"(?i)(?:https?://|www\.)[a-zA-Z0-9\-]+(?:\.[a-zA-Z0-9\-]+)*\.[a-zA-Z]{2,}(?:/[^\s]*)?"
YEAR = r"\b(?:19|20)\d{2}\b"
MONTH_YEAR = rf"(?i)\b({MONTH})[\s.,\-/]*((?:19|20)\d{{2}})\b"
_POINT = rf"{MONTH}[\s.,\-/]*(?:19|20)\d{{2}}|(?:0?[1-9]|1[0-2])[/\-](?:19|20)\d{{2}}|(?:19|20)\d{{2}}"
DATE_RANGE = rf"(?i)({_POINT})\s*[-–—to/]+\s*({_POINT}|{PRESENT})"
GPA = r"(?i)(?:GPA|CGPA|Grade|Score)\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(?:/\s*(\d+(?:\.\d+)?))?"
SECTION_DIVIDER = r"^[\s\-_=*#~]{3,}$"
ALL_CAPS_HEADER = r"^[A-Z][A-Z\s&/\-]{2,}$"
BULLET_POINT = r"^\s*[•●◦‣▸▹►▻\-*+>]\s+"
PAGE_NUMBER = r"(?i)^\s*(?:page\s*)?\d+\s*(?:of\s*\d+)?\s*$"
MULTIPLE_SPACES, MULTIPLE_NEWLINES = " {2,}", "\n{3,}"
NON_ASCII, CONTROL_CHARS = r"[^\x00-\x7F]+", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SENIORITY = r"(?i)\b(junior|senior|lead|principal|staff|associate|mid[- ]?level|entry[- ]?level|head|director|vp|vice\s+president|chief|manager|intern)\b"
DEGREE = (
    r"(?i)\b(B\.?Sc\.?|B\.?Tech\.?|B\.?S\.?|B\.?A\.?|B\.?E\.?|Bachelor(?:\s+of\s+(?:Science|Arts|Engineering|Technology))?|"
    r"M\.?B\.?A\.?|M\.?Sc\.?|M\.?Tech\.?|M\.?S\.?|M\.?A\.?|M\.?E\.?|Master(?:\s+of\s+(?:Science|Arts|Business\s+Administration|Engineering|Technology))?|"
    r"Ph\.?D\.?|Doctor(?:\s+of\s+Philosophy)?|Associate(?:\s+of\s+(?:Arts|Science|Applied\s+Science))?|Diploma|Certificate|High\s+School|Secondary)(?![A-Za-z])"
)
CERT_ABBREVIATIONS = (
    r"\b(AWS|GCP|AZURE|CPA|CFA|PMP|CISSP|CEH|OSCP|CISM|CISA|CCNA|CCNP|MCSA|MCSE|RHCE|RHCSA|OCA|OCP|ITIL|PRINCE2|SCRUM|CSM|CSPO|PSM|SAFe|"
    r"CKA|CKAD|CKS|AZ-900|AZ-104|AZ-204|DP-900)\b"
)
COMPANY_SUFFIX = r"(?i)\b(?:Inc|Ltd|LLC|Corp|Co|GmbH|AG|SA|PLC|Group|Holdings)\b\.?"
INSTITUTION = r"(?i)(?:university|college|institute|school|academy|polytechnic|faculty|campus)"
TITLE_WORD = r"(?i)\b(?:engineer|developer|manager|analyst|consultant|designer|architect|lead|senior|junior|intern|associate|director|officer|head|specialist|coordinator|executive|scientist|administrator)\b"
