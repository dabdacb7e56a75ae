"""Profile -> chunk ends of a value in memory: all of them, or a rejection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from sediment.functions.gear import low_cuts
from sediment.functions.profiles import AUDIO, DOCUMENT_UNIT_MIN, GENERIC, GENERIC_MASKS, ISOBMFF, MATROSKA, MIN_CHUNK, MPEGTS, OOXML, OOXML_BER, PDF, TEXT, ZIP, Rejected, known
from sediment.operators import archive, content, media, office, pdf
from sediment.operators.cuts import assemble


def _structured(profile: str, units: Callable[[bytes], list[tuple]], unit_min: int = MIN_CHUNK) -> Callable[[bytes], list[int]]:
    def ends(data: bytes) -> list[int]:
        found = units(data)
        return assemble(len(data), found, *low_cuts(np.frombuffer(data, np.uint8), profile, GENERIC_MASKS), unit_min=unit_min)

    return ends


CHUNKERS: dict[str, Callable[[bytes], list[int]]] = {
    GENERIC: content.generic,
    TEXT: content.text,
    ZIP: _structured(ZIP, archive.units),
    ISOBMFF: _structured(ISOBMFF, media.isobmff_units),
    MATROSKA: _structured(MATROSKA, media.matroska_units),
    MPEGTS: media.mpegts,
    AUDIO: media.framed_audio,
    OOXML: office.ooxml,
    OOXML_BER: office.ooxml_ber,
    PDF: _structured(PDF, pdf.units, DOCUMENT_UNIT_MIN),
}


def boundaries(profile: str, data: bytes, expected: str | None = None) -> list[int]:
    """Chunk ends, in the profile's canonical form; Rejected if the profile can't read the value."""
    if expected is not None:
        if profile not in (OOXML, OOXML_BER):
            raise ValueError("an Office kind can be expected of packages only")
        return (office.ooxml if profile == OOXML else office.ooxml_ber)(data, expected)
    return CHUNKERS[known(profile)](data)


def canonical_form(profile: str, data: bytes) -> bytes:
    """The bytes that the ends address: the value itself but for canonical packages."""
    return office.canonical(data).data if profile == OOXML else data


def chunks(profile: str, data: bytes) -> list[bytes]:
    form, out, at = canonical_form(profile, data), [], 0
    for end in boundaries(profile, data):
        out.append(form[at:end])
        at = end
    return out


__all__ = ["CHUNKERS", "Rejected", "boundaries", "canonical_form", "chunks"]
