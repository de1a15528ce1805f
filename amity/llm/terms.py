"""Terms of a UTF-8 text: longest runs of ASCII letters, digits and non-ASCII
characters, A-Z in lower case."""

from __future__ import annotations

from collections.abc import Iterator

SPACE_BYTE = 0x20


def _kept(byte: int) -> int:
    if 0x41 <= byte <= 0x5A:
        return byte + 0x20
    if 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A or byte >= 0x80:
        return byte
    return SPACE_BYTE


#: Every byte of a UTF-8 text to the byte of a term, or to a space between terms.
TERM_BYTES = bytes(_kept(b) for b in range(256))
#: The same terms as a regular expression over text in which A-Z are already lower-cased.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: bytes | None, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about ``piece`` bytes, so that
    a very long text never stands in memory as one list of words."""
    if not text:
        return
    flat = text.translate(TERM_BYTES)
    at = 0
    while len(flat) - at > piece:
        cut = flat.rfind(b" ", at, at + piece)
        if cut < 0:
            cut = flat.find(b" ", at + piece)
            if cut < 0:
                break
        yield flat[at:cut].split()
        at = cut
    yield flat[at:].split()
