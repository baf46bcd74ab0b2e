"""Rules for file events, blob names and upload checks."""

from pyspark.sql import functions as F

# Event type, extensions, content types and limits.
CREATED_EVENT = "Microsoft.Storage.BlobCreated"
SUPPORTED_EXTENSIONS = ["pdf", "png", "jpg", "jpeg", "tiff", "tif"]
UPLOAD_CONTENT_TYPES = ["application/pdf", "image/png", "image/jpeg", "image/tiff"]
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
CONTENT_TYPE_BY_EXTENSION = {
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "tiff": "image/tiff",
    "tif": "image/tiff",
}


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def subject_prefix(container):
    """Prefix an event subject must have to belong to the container."""
    return f"/blobServices/default/containers/{container}/blobs/"


def blob_name(subject, url):
    """Text after the first `/blobs/` of the subject, else of the url, else null."""
    subject, url = _col(subject), _col(url)

    def after(c):
        return F.regexp_extract(c, r"(?s)/blobs/(.*)$", 1)

    return F.when(subject.contains("/blobs/"), after(subject)).when(
        url.contains("/blobs/"), after(url)
    )


def extension(name):
    """Lower-cased text after the last dot; null when there is no dot."""
    name = _col(name)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))


def is_supported_file(name):
    return F.coalesce(extension(name).isin(SUPPORTED_EXTENSIONS), F.lit(False))


def path_source(name):
    """`email` or `upload` for paths of three parts or more, else `unknown`."""
    parts = F.split(_col(name), "/")
    return (
        F.when(F.size(parts) < 3, F.lit("unknown"))
        .when(F.get(parts, F.lit(0)) == "email", F.lit("email"))
        .otherwise(F.lit("upload"))
    )


def path_user(name):
    parts = F.split(_col(name), "/")
    return F.when(F.size(parts) < 3, F.lit("unknown")).otherwise(F.get(parts, F.lit(0)))


def path_upload_id(name):
    parts = F.split(_col(name), "/")
    return F.when(F.size(parts) < 3, F.lit("")).otherwise(F.get(parts, F.lit(1)))


def upload_path(user_id, upload_id, filename):
    return F.concat_ws("/", _col(user_id), _col(upload_id), _col(filename))


def content_type_of(name):
    """Content type that belongs to the file's extension, null for others."""
    table = F.create_map(*[F.lit(x) for pair in CONTENT_TYPE_BY_EXTENSION.items() for x in pair])
    return F.try_element_at(table, F.coalesce(extension(name), F.lit("")))


def is_accepted_upload(content_type, length):
    """Content type in the list and no more than 25 MiB."""
    ok = _col(content_type).isin(UPLOAD_CONTENT_TYPES) & (_col(length) <= MAX_UPLOAD_BYTES)
    return F.coalesce(ok, F.lit(False))


def stable_id(*parts):
    """An id that a second delivery of the same input gets again."""
    return F.sha2(F.concat_ws("|", *[_col(p) for p in parts]), 256)


def utc_now_text():
    """Current time as ISO text with offset."""
    return F.date_format(
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'",
    )
