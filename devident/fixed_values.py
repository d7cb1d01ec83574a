"""Fixed values that decide results: names, tiers, notes, patterns, formats and limits.

They are data, not logic; changing one changes what every report says.
"""

# Labels stored in tables
SCANNER_MODEL_NAME = "nmap"
SCANNER_TOOL_NAME = "nmap"
SCORER_VERSION = "1.0"
PARSER_VERSION = "1.0"
INPUT_VARIANT = "plain-text"
STATUS_COMPLETE = "complete"
STATUS_ERROR = "error"
STATUS_PENDING = "pending"

# Tiers of accepted identifiers: score and rank
TIER_SCORES = {"exact": 1.0, "partial": 0.5, "related": 0.25, "none": 0.0}
TIER_RANKS = {"exact": 3, "partial": 2, "related": 1, "none": 0}
DEFAULT_TIER = "exact"
NO_TIER = "none"

# Notes on score rows
NOTE_MALFORMED = "malformed CPE string"
NOTE_NO_PREDICTION = "no predicted CPEs"

# CPE 2.3 fields after the two prefix tokens
CPE_FIELDS = [
    "part", "vendor", "product", "version", "update", "edition",
    "language", "sw_edition", "target_sw", "target_hw", "other",
]
CPE_TOKENS = 13

# White space as Unicode strings know it (for stripping and in patterns)
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITE_SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
NON_SPACE_CLASS = WHITE_SPACE_CLASS.replace("[", "[^", 1)

# Patterns over model output and scripts
FENCED_OBJECT = r"(?s)```(?:json)?" + WHITE_SPACE_CLASS + r"*(\{.*?\})" + WHITE_SPACE_CLASS + "*```"
BARE_CPE_OBJECT = r'(?s)\{[^{}]*"cpe[^{}]*\}'
NETBIOS_NAME = "NetBIOS name:" + WHITE_SPACE_CLASS + "*(" + NON_SPACE_CLASS + "+)"
NETBIOS_SCRIPT = "nbstat"

# Text payload: labels, layout and cuts
PAYLOAD_DEVICE = "Device: "
PAYLOAD_SCAN = "Scan:   "
PAYLOAD_IP = "IP:     "
PAYLOAD_HOSTNAME = "Hostname: "
PAYLOAD_VENDOR = "Vendor (nmap): "
PAYLOAD_UNKNOWN = "unknown"
PAYLOAD_OS = "OS Guesses:"
PAYLOAD_NO_OS = "  (none detected)"
PAYLOAD_PORTS = "Open Ports:"
PAYLOAD_NONE = "  (none)"
PAYLOAD_PORT_LINE = "  %-12s %-10s %s"
PAYLOAD_PORT_CPE = "    nmap CPE: "
PAYLOAD_HOST_SCRIPTS = "Host Scripts:"
PAYLOAD_DISCOVERY = "Discovery Scripts:"
PAYLOAD_CPES = "nmap CPE Guesses (all services):"
PORT_SCRIPT_CUT = 200
HOST_SCRIPT_CUT = 500

# Text forms of timestamps
CREATED_FORMAT = "yyyy-MM-dd HH:mm:ss"
RUN_STAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
REPORT_STAMP_FORMAT = "%Y%m%d_%H%M%S"
