"""Fixed values that must equal the upstream service's for right results.

They are stated here once, as plain text, and used by name everywhere else.
"""

# --- fixed values: register API addresses (public court-register API) ------
EXTRACT_CURRENT_URL = "https://api-krs.ms.gov.pl/api/krs/OdpisAktualny/{krs}?rejestr={registry}&format=json"
EXTRACT_FULL_URL = "https://api-krs.ms.gov.pl/api/krs/OdpisPelny/{krs}?rejestr={registry}&format=json"
BULLETIN_URL = "https://api-krs.ms.gov.pl/api/Krs/Biuletyn/{day}?godzinaOd={hour_from}&godzinaDo={hour_to}"
# The daily sweep asks for the whole day: hours 0 to 23, written unpadded.
SWEEP_HOUR_FROM = 0
SWEEP_HOUR_TO = 23

# --- fixed values: registries and extract kinds ----------------------------
REGISTRIES = ["P", "S"]              # tried in this order
EXTRACT_KINDS = ["aktualny", "pelny"]
NOT_FOUND_STATUS = 404
OK_STATUS = 200

# --- fixed values: dispatch routes of the daily sweep ----------------------
DISPATCH_ROUTES = [
    ("business_information", "/krs-api/update-business-information/{krs}"),
    ("document_list", "/krs-df/update-document-list/{krs}"),
]

# --- fixed values: document listing ----------------------------------------
LISTING_PAGE_SIZE = 10
LISTING_COLUMNS = [
    "document_id",
    "document_type",
    "document_name",
    "document_from",
    "document_to",
    "document_status",
    "internal_element_id",
]
DETAILS_LINK_TEXT = "Pokaż szczegóły"
PAGER_PATTERN = r"Strona: \s*\d+/(\d+)"
FILENAME_PATTERN = r'filename="(.+?)"'
FILE_ERROR_WORD = "error"

# --- fixed values: page markers, in precedence order -----------------------
MAINTENANCE_TITLE = "Przerwa techniczna"
NO_DOCUMENTS_TEXT = "Brak dokumentów dla KRS:"
CANNOT_DISPLAY_TEXT = "Witryna sieci Web nie może wyświetlić strony"
THROTTLED_TEXT = "Wymagane oczekiwanie pomiędzy kolejnymi wywołaniami"
LISTING_UPDATE_IDS = ["searchForm", "searchForm:docTable"]
MESSAGE_UPDATE_PREFIX = "unloggedForm:j_idt"
VIEWROOT_UPDATE_ID = "javax.faces.ViewRoot"

# --- fixed values: job queues and states -----------------------------------
QUEUES = ["KRSAPI", "KRSDF"]
JOB_STATES = ["queued", "started", "deferred", "scheduled", "failed", "finished"]
# output column for each state, in the order of the queue-counter record
JOB_STATE_COLUMNS = [
    ("queued", "jobs_enqueued"),
    ("started", "jobs_started"),
    ("deferred", "jobs_deferred"),
    ("scheduled", "jobs_scheduled"),
    ("failed", "jobs_failed"),
    ("finished", "jobs_finished"),
]
JOB_END_STATES = ["finished", "failed"]

# --- fixed values: change events -------------------------------------------
CHANGE_OPS_KEPT = ["c", "r"]        # create and snapshot read carry a version
KRS_LENGTH = 10
