"""Fixed values of the protocol, byte for byte, and its defaults."""

#: Fixed: labels that separate the uses of derived keys.
NETWORK_MAC = b"lux/v1/network-mac"
MANIFEST_KEY = b"lux/v1/manifest-key"
MANIFEST_NONCE = b"lux/v1/manifest-nonce"
CHUNK_KEY_BASE = b"lux/v1/chunk-key-base"
CHUNK_KEY = b"lux/v1/chunk-key"
CHUNK_NONCE = b"lux/v1/chunk-nonce"
BLOB_KEY = b"lux/v1/blob-key"

#: Fixed: the scheme of identifiers in text, and the digests of empty content and of the empty tree.
URI_SCHEME = "lux"
EMPTY_DAG_LABEL = b"lux/v1/empty-dag"
EMPTY_BLOB_ID = bytes.fromhex("af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262")
EMPTY_DAG_REF = bytes.fromhex("98406f28ac2f17f4fa1b6f756a51a6b91b1d953f466a5e7730f9ee6acc7c3e59")

#: Fixed: sizes in bytes, message kinds and error codes.
HASH, NONCE, TAG, SIGNATURE = 32, 24, 16, 64
MESSAGES = {0: "Ping", 1: "Pong", 2: "FindNode", 3: "FindNodeResponse", 4: "StoreRecord", 5: "StoreRecordResponse", 6: "FindValue", 7: "FindValueResponse", 10: "GetChunk", 11: "GetChunkResponse", 12: "StoreChunk", 13: "StoreChunkResponse", 20: "GetManifest", 21: "GetManifestResponse", 22: "PublishManifest", 23: "PublishManifestResponse", 255: "Error"}
ERRORS = {0: "Unknown", 1: "NotFound", 2: "InvalidRequest", 3: "AuthFailed", 4: "Timeout", 5: "StorageFull", 6: "RateLimited"}

#: Defaults.
MAX_SKEW_MS = 300_000
MAX_RECORD_BYTES = 65_536
MAX_HOLDERS = 64
RECORD_TTL_MS = 86_400_000
STALE_SECONDS = 3600
K, ALPHA = 20, 3
DAY_MS = 86_400_000
LEASE_TTL_MS = 7 * DAY_MS
CHECK_INTERVAL_MS = 3_600_000
#: (least replicas, lease time in ms, threshold under which a chunk is repaired)
POLICIES = {"default": (3, LEASE_TTL_MS, 3), "high": (5, 14 * DAY_MS, 4), "low": (2, DAY_MS, 1)}
CACHE_BYTES, DISK_BYTES = 256 << 20, 10 << 30
