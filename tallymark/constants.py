"""Fixed values.

Everything below must equal the published formats for results to agree: field
names, prompts, status rules, accepted types and limits. Only values live here.
"""

# --- identity-card payload: field names and the label column each is read from ---
FRONT_COLUMNS = {
    "id_number": 1,
    "full_name": 2,
    "date_of_birth": 3,
    "gender": 4,
    "nationality": 5,
    "place_of_origin": 6,
    "date_of_expiry": 7,
    "place_of_residence": 8,
}
BACK_COLUMNS = {"special_mark": 9, "back_date": 10}
MRZ_COLUMNS = {
    "country": 12,
    "document_number": 13,
    "document_number_checksum": 14,
    "document_number_checksum_validate": 15,
    "personal_number": 16,
    "personal_number_checksum": 17,
    "personal_number_checksum_validate": 18,
    "dob": 19,
    "dob_checksum": 20,
    "dob_checksum_validate": 21,
    "gender": 22,
    "due_date": 23,
    "due_date_checksum": 24,
    "due_date_checksum_validate": 25,
    "nationality": 26,
    "checksum": 27,
    "sur_name": 28,
    "given_name": 29,
}
NAME_COLUMNS = (0, 11)
LABEL_COLUMN_COUNT = 30
DOCUMENT_TYPE = "cccd"
SIDES = ("front", "back")
REASONS = ("blank_name", "missing_file", "mixed_side", "no_side_data", "ambiguous_name")

# --- prompts ---
SYSTEM_PROMPT = (
    "You are a strict OCR-to-JSON transcriber for Vietnamese CCCD documents. "
    "Output exactly one minified JSON object and nothing else. "
    "Do not use markdown, code fences, comments, or explanations. "
    "Preserve visible text exactly as written; do not normalize dates, names, punctuation, or casing. "
    "Use null for any unreadable or missing value. "
    "Do not invent information. "
    "Keep only the keys specified in the schema and do not reorder the schema conceptually."
)
SIDE_PROMPT = (
    "<image>\n"
    "Extract the {label} side of the Vietnamese CCCD.\n"
    "Return JSON matching this exact schema:\n"
    "{schema}\n"
    "Rules:\n"
    "- Keep every key exactly as written.\n"
    "- Use null for unreadable or absent values.\n"
    "- Do not add extra keys.\n"
    "- Do not normalize dates; keep the source format as seen."
)
CLASSIFY_PROMPT_HEAD = (
    "You are an expert document classification and segmentation system.\n"
    "The input contains {page_count} page image(s), provided in physical page order.\n\n"
    "Allowed document groups:\n"
)
CLASSIFY_PROMPT_TAIL = (
    "\n\n"
    "Return every logical document matching one of the allowed groups.\n"
    "document_code must be the matched group_code. group_name must be the canonical group_name.\n"
    "document_name must be the real title observed on the document; if unreadable, use the closest variant or group_name.\n"
    'Use document_code "unknown" only if the provided schema list includes group_code "unknown". '
    "Otherwise ignore documents that do not match a provided group.\n\n"
    "For each document return page_ranges, page_order, and duplicate_pages.\n"
    "page_order is a flat array of physical page numbers in logical reading order.\n"
    "page_ranges is an array of [start_page, end_page] physical page ranges. Use separate ranges for non-adjacent pages.\n"
    "duplicate_pages lists duplicate scans as {page, duplicate_of}; duplicate pages must not appear in page_order or page_ranges.\n"
    "Return only JSON matching the requested schema."
)
EXTRACT_PROMPT_HEAD = (
    "You are an expert document extraction system.\n"
    'Document code: "{document_code}".\n'
    "Canonical group name: {group_name}.\n"
    "Observed document name: {document_name}.\n"
    "Physical pages supplied for this document: {page_order}.\n\n"
    "Extract only the requested structured data for this document.\n"
    "If a requested field or value is not visible, set that field to null.\n"
    "Do not infer values from neighboring labels or unrelated rows.\n"
    "For date fields, use ISO 8601 format YYYY-MM-DD when the date is clear.\n"
    "For number fields, output a JSON number without currency symbols or thousand separators.\n"
    "For boolean fields, output true only when a real mark/tick/affirmative value is present; otherwise false.\n\n"
    "Fields/schema:\n"
)
EXTRACT_PROMPT_UNKNOWN = (
    "Unknown document. Extract readable non-table key-value fields into fields[] and tabular content into tables[]. "
    "Use English snake_case keys and keep field/table labels in the original document language. "
    "For table rows, output cells as an array of {key, value} objects."
)
EXTRACT_PROMPT_TAIL = "\n\nReturn only JSON matching the requested schema."

# --- inference requests ---
REQUEST_TEMPERATURE = 0
REQUEST_MAX_TOKENS = 1024
DEFAULT_ROW_IMAGE_MIME = "application/octet-stream"

# --- free-form payload of documents without a declared group ---
UNKNOWN_KEYS = ("fields", "tables")
UNKNOWN_FIELD_KEYS = ("field_key", "field_name", "value")
UNKNOWN_TABLE_KEYS = ("table_key", "table_name", "columns", "rows")
UNKNOWN_COLUMN_KEYS = ("key", "label")
UNKNOWN_ROW_KEYS = ("cells",)
UNKNOWN_CELL_KEYS = ("key", "value")

# --- document groups ---
FIELD_TYPES = ("string", "number", "boolean", "date", "array")
GROUP_CODE_PATTERN = "^[a-z0-9_]+$"

# --- fetch log ---
ACCEPTED_MIME_TYPES = (
    "image/png",
    "image/jpeg",
    "image/jpg",
    "image/webp",
    "application/pdf",
)
VAGUE_MIME_TYPES = ("", "application/octet-stream", "binary/octet-stream")
MAX_REDIRECTS = 5
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_PDF_PAGES = 20
MAX_FILE_NAME = 100
DEFAULT_FILE_NAME = "downloaded_file"

# --- standard media types by file extension ---
EXTENSION_MIME = {
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "jpe": "image/jpeg",
    "webp": "image/webp",
    "gif": "image/gif",
    "bmp": "image/bmp",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "svg": "image/svg+xml",
    "html": "text/html",
    "htm": "text/html",
    "txt": "text/plain",
    "csv": "text/csv",
    "xml": "text/xml",
    "json": "application/json",
    "zip": "application/zip",
}

# --- IPv4 ranges that are not globally reachable (IANA special-purpose registry) ---
RESERVED_IPV4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
)
# Addresses inside the ranges above that are globally reachable after all.
REACHABLE_IPV4 = ("192.0.0.9/32", "192.0.0.10/32")
#: Special-purpose blocks of IPv6 that are not globally reachable, and the
#: parts of them that are.
RESERVED_IPV6 = (
    "::/128", "::1/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    "fc00::/7", "fe80::/10",
)
REACHABLE_IPV6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)

# --- artifact catalog ---
FORMAT_TARGETS = {
    "safetensors": ("vllm", "sglang", "mlx"),
    "pytorch": ("vllm", "sglang", "mlx"),
    "gguf": ("llama.cpp", "ollama"),
}
KNOWN_TARGETS = ("vllm", "sglang", "llama.cpp", "ollama", "mlx")
FORMAT_SUFFIX = {"safetensors": ".safetensors", "gguf": ".gguf", "pytorch": ".bin"}
# Checked in this order when the format of a directory is detected.
DETECTION_ORDER = ((".safetensors", "safetensors"), (".bin", "pytorch"), (".gguf", "gguf"))
CONVERTED_TARGETS = ("llama.cpp", "ollama")
FLOATING_TAGS = ("latest", "main", "main-stable", "stable", "dev")
FLOATING_PREFIX = "nightly"
# Runtimes that accept a gateway binding, and those a catalog model can be bound to.
BINDING_RUNTIMES = ("ollama", "vllm", "sglang", "llama.cpp", "mlx")
REGISTRY_RUNTIMES = ("vllm", "sglang", "llama.cpp", "mlx")

# --- metrics ---
SCRAPE_SECONDS = 15
LOOKBACK_SECONDS = 300
EXPORTED_GAUGES = {
    "ollama_up": "Whether the Ollama API is reachable.",
    "ollama_scrape_duration_seconds": "Time spent scraping Ollama API endpoints.",
    "ollama_models_total": "Number of models available to Ollama.",
    "ollama_loaded_models_total": "Number of models currently loaded by Ollama.",
    "ollama_model_info": "Available Ollama model metadata.",
    "ollama_loaded_model_info": "Loaded Ollama model metadata.",
    "ollama_loaded_model_size_bytes": "Loaded Ollama model size in bytes.",
    "ollama_loaded_model_size_vram_bytes": "Loaded Ollama model VRAM size in bytes.",
}
# Dashboard sums: the first metric that has samples wins.
SUM_FALLBACKS = {
    "requests": (
        "litellm_proxy_total_requests_metric",
        "litellm_proxy_total_requests_metric_total",
        "litellm_requests_metric_total",
    ),
    "failed": (
        "litellm_proxy_failed_requests_metric",
        "litellm_proxy_failed_requests_metric_total",
    ),
    "in_flight": (
        "litellm_in_flight_requests",
        "litellm_inflight_requests_metric",
        "litellm_in_flight_requests_metric",
    ),
    "input_tokens": ("litellm_input_tokens_metric", "litellm_input_tokens_metric_total"),
    "output_tokens": ("litellm_output_tokens_metric", "litellm_output_tokens_metric_total"),
}
