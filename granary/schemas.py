"""Fixed schemas of the tables that operators exchange. Names and contents that need not be UTF-8 are binary."""

STAT = "struct<mode: int, uid: bigint, gid: bigint, mtime: bigint, xattrs: map<binary, binary>>"
ENTRIES = f"image_id string, path binary, kind string, leaf_id bigint, stat {STAT}"
LEAVES = f"image_id string, leaf_id bigint, kind string, inline binary, object_id string, size bigint, rdev bigint, target binary, stat {STAT}"
OBJECTS = "object_id string, size bigint, data binary"
STREAMS = "name string, object_id string, content_type bigint, total_size bigint, object_refs array<string>, named_refs map<string, string>"
IMAGES = "name string, object_id string"
REFS = "category string, name string, target string"
REFERRERS = "subject string, artifact string"
LAYER_ENTRIES = "layer_idx int, entry_idx bigint, path string, item string, target string"
CHUNKS = "stream_id string, seq bigint, kind string, inline binary, object_id string, size bigint"
DUMP = (
    "line_no bigint, path binary, size bigint, mode int, nlink bigint, uid bigint, gid bigint, rdev bigint, mtime_sec bigint, mtime_nsec bigint, "
    "payload binary, content binary, digest string, xattrs map<binary, binary>, hardlink boolean, error string"
)
LAYERS_JSON = "id string, parent string, `diff-digest` string, `diff-size` bigint, `compressed-size` bigint"
IMAGES_JSON = "id string, names array<string>"
TAR_SPLIT = "type int, name string, size bigint, payload string, crc64 string, position bigint"
META_JSON = "version int, algorithm string, features struct<compatible: array<string>, `read-only-compatible`: array<string>, incompatible: array<string>>"
ERRORS = "type string, path string, object_id string, ref_name string, detail string"
#: Fixed values of the formats.
INLINE_MAX, INLINE_READ_MAX, SYMLINK_MAX, PATH_MAX = 64, 512, 1024, 4096
XATTR_NAME_MAX, XATTR_VALUE_MAX = 255, 65535
