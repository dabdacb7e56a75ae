"""Profiles, registries and the constants every chunker shares."""

from __future__ import annotations

from dataclasses import dataclass

# Sizes, profile names and ids, seeds, masks, essences and extensions decide where content is cut.
MIN_CHUNK = 16 * 1024
TARGET_CHUNK = 64 * 1024
MAX_CHUNK = 256 * 1024
DOCUMENT_UNIT_MIN = 4 * 1024
PROBE_BYTES = 512

PROFILES = (
    "generic-cdc-v1",
    "structured-text-v1",
    "zip-v1",
    "isobmff-v1",
    "matroska-v1",
    "mpegts-v1",
    "framed-audio-v1",
    "ooxml-v1",
    "ooxml-ber-v1",
    "pdf-v1",
)
GENERIC, TEXT, ZIP, ISOBMFF, MATROSKA, MPEGTS, AUDIO, OOXML, OOXML_BER, PDF = PROFILES
IDS = {name: i + 1 for i, name in enumerate(PROFILES)}
SEED = "legra/{}/gear"

GENERIC_MASKS = (0x3FFFF, 0x3FFF)
TEXT_MASKS = (0xFFC0000000000000, 0xFFE0000000000000)
MPEGTS_MASKS = (0xF000000000000000, 0xC000000000000000)
AUDIO_MASKS = (0xFE00000000000000, 0xF800000000000000)

_TEXT_ESSENCES = (
    "text/plain text/markdown text/html text/css text/csv text/tab-separated-values text/xml text/calendar "
    "text/vcard text/javascript text/turtle text/n3 application/json application/ld+json application/xml "
    "application/xhtml+xml application/rdf+xml application/n-triples application/n-quads application/trig "
    "application/sparql-query application/sparql-update application/sparql-results+json "
    "application/sparql-results+xml application/yaml application/toml application/javascript image/svg+xml"
).split()
_ZIP_ESSENCES = (
    "application/zip application/java-archive application/epub+zip application/vnd.oasis.opendocument.text "
    "application/vnd.oasis.opendocument.spreadsheet application/vnd.oasis.opendocument.presentation"
).split()
_OFFICE = "application/vnd.openxmlformats-officedocument."
_OOXML_ESSENCES = [_OFFICE + x for x in ("wordprocessingml.document", "spreadsheetml.sheet", "presentationml.presentation")]
_MEDIA_ESSENCES = {
    ISOBMFF: "video/mp4 audio/mp4 application/mp4 video/quicktime image/heif image/heic image/avif".split(),
    MATROSKA: "video/x-matroska audio/x-matroska video/webm audio/webm".split(),
    MPEGTS: ["video/mp2t"],
    AUDIO: "audio/mpeg audio/aac audio/flac".split(),
}
OFFICE_PARTS = {"word": "word/document.xml", "excel": "xl/workbook.xml", "powerpoint": "ppt/presentation.xml"}
EXTENSIONS = {
    "pdf": "application/pdf", "docx": _OOXML_ESSENCES[0], "xlsx": _OOXML_ESSENCES[1], "pptx": _OOXML_ESSENCES[2],
    "odt": _ZIP_ESSENCES[3], "ods": _ZIP_ESSENCES[4], "odp": _ZIP_ESSENCES[5], "txt": "text/plain", "md": "text/markdown",
    "html": "text/html", "htm": "text/html", "css": "text/css", "csv": "text/csv", "tsv": "text/tab-separated-values",
    "xml": "application/xml", "json": "application/json", "yaml": "application/yaml", "yml": "application/yaml",
    "toml": "application/toml", "js": "text/javascript", "svg": "image/svg+xml", "ttl": "text/turtle", "n3": "text/n3",
    "nt": "application/n-triples", "nq": "application/n-quads", "trig": "application/trig", "png": "image/png",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic",
    "heif": "image/heif", "avif": "image/avif", "mp3": "audio/mpeg", "aac": "audio/aac", "flac": "audio/flac",
    "mp4": "video/mp4", "m4a": "audio/mp4", "mov": "video/quicktime", "mkv": "video/x-matroska", "webm": "video/webm",
    "ts": "video/mp2t", "zip": "application/zip", "jar": "application/java-archive", "epub": "application/epub+zip",
    "tar": "application/x-tar", "gz": "application/gzip", "tgz": "application/gzip",
}


def registry(version: int = 2) -> dict[str, str]:
    """Essence -> profile. Version 1 knows Office packages as plain archives and has no profile for PDF."""
    if version not in (1, 2):
        raise ValueError(f"no registry of version {version}")
    found = dict.fromkeys(_TEXT_ESSENCES, TEXT) | dict.fromkeys(_ZIP_ESSENCES, ZIP)
    found |= dict.fromkeys(_OOXML_ESSENCES, ZIP if version == 1 else OOXML)
    if version == 2:
        found["application/pdf"] = PDF
    for profile, essences in _MEDIA_ESSENCES.items():
        found |= dict.fromkeys(essences, profile)
    return found


def name_of(profile_id: int) -> str:
    """The wire id's name; ids that no profile has yet are shown, not refused."""
    return PROFILES[profile_id - 1] if 1 <= profile_id <= len(PROFILES) else f"unknown-profile-{profile_id}"


def known(profile: str) -> str:
    if profile not in IDS:
        raise ValueError(f"unknown profile {profile!r}")
    return profile


@dataclass
class Rejected(Exception):
    """A stream that its profile can't read: the whole stream is refused."""

    detail: str
    offset: int | None = None
    kind: str = "MalformedProfileInput"

    def __str__(self) -> str:
        return self.detail
