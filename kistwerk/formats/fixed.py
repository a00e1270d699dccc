"""Values fixed by the file formats and by the report contract."""

# Container header and sector markers.
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
HEADER_SIZE = 512
DIFAT_SLOTS = 109
BYTE_ORDER = 0xFFFE
MINOR_VERSION = 0x003E
SECTOR_SHIFT = {3: 9, 4: 12}
MINI_SHIFT = 6
MINI_CUTOFF = 4096
FREE = 0xFFFFFFFF
END_OF_CHAIN = 0xFFFFFFFE
FAT_SECTOR = 0xFFFFFFFD
DIFAT_SECTOR = 0xFFFFFFFC
NO_STREAM = 0xFFFFFFFF
ENTRY_SIZE = 128
STORAGE, STREAM, ROOT = 1, 2, 5
KIND_NAMES = {1: "storage", 2: "stream", 5: "root"}
ROOT_NAME = "Root Entry"
LONGEST_NAME, LONGEST_PATH = 31, 4096

# Error codes.
INVALID_ARGUMENT = "INVALID_ARGUMENT"
NOT_FOUND = "NOT_FOUND"
CONFLICT = "CONFLICT"
READ_ONLY = "READ_ONLY"
UNSUPPORTED = "UNSUPPORTED"
BAD_HEADER = "BAD_HEADER"
BAD_SECTOR = "BAD_SECTOR"
BAD_FAT_CHAIN = "BAD_FAT_CHAIN"
CYCLE_DETECTED = "CYCLE_DETECTED"
OUT_OF_BOUNDS = "OUT_OF_BOUNDS"
DIR_CORRUPT = "DIR_CORRUPT"
MINISTREAM_CORRUPT = "MINISTREAM_CORRUPT"
LIMIT_EXCEEDED = "LIMIT_EXCEEDED"
DEPTH_EXCEEDED = "DEPTH_EXCEEDED"
QUOTA_EXCEEDED = "QUOTA_EXCEEDED"
TX_CLOSED = "TX_CLOSED"
COMMIT_FAILED = "COMMIT_FAILED"
REVERT_FAILED = "REVERT_FAILED"

# Property types, format ids and property ids.
VT_EMPTY, VT_I2, VT_I4, VT_R4, VT_R8, VT_BOOL, VT_UI4, VT_I8, VT_UI8, VT_LPSTR, VT_LPWSTR, VT_FILETIME = 0x00, 0x02, 0x03, 0x04, 0x05, 0x0B, 0x13, 0x14, 0x15, 0x1E, 0x1F, 0x40
SUMMARY = "f29f85e0-4ff9-1068-ab91-08002b27b3d9"
DOCUMENT_SUMMARY = "d5cdd502-2e9c-101b-9397-08002b2cf9ae"
SUMMARY_STREAMS = ("/\x05SummaryInformation", "/SummaryInformation")
DOCUMENT_SUMMARY_STREAMS = ("/\x05DocumentSummaryInformation", "/DocumentSummaryInformation")
PROPERTY_IDS = {
    "code_page": 1, "title": 2, "subject": 3, "author": 4, "keywords": 5, "comments": 6, "template": 7, "last_author": 8, "rev_number": 9,
    "edit_time": 10, "last_printed": 11, "create_time": 12, "last_save_time": 13, "page_count": 14, "word_count": 15, "char_count": 16, "app_name": 18, "security": 19,
}
FILETIME_EPOCH = 11644473600  # seconds from 1601 to 1970

# First bytes of images, in the order in which they are tried.
IMAGE_MAGIC = (
    ("image/png", bytes.fromhex("89504E470D0A1A0A")),
    ("image/jpeg", bytes.fromhex("FFD8FF")),
    ("image/gif", b"GIF87a"),
    ("image/gif", b"GIF89a"),
    ("image/bmp", b"BM"),
    ("image/tiff", bytes.fromhex("49492A00")),
    ("image/tiff", bytes.fromhex("4D4D002A")),
)
