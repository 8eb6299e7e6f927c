"""Archives that were gzipped as a whole: one damaged record, a cut and a wrong checksum lose only what they hit."""

import gzip
import io

from test_copies import _records

from tablelens.llm import warc


def salvaged(data):
    rows = list(warc.Archive(io.BytesIO(data), len(data)).salvage())
    return [f["warc-record-id"] for _, _, f, _, _ in rows if f], [r for *_, r in rows if r]


def names(*which):
    return [f"<urn:x-page:{k}>" for k in which]


def test_a_damaged_record_in_a_member():
    for hurt in range(6):
        parts = _records(6, False)
        begin, size = sum(map(len, parts[:hurt])), len(parts[hurt])
        parts[hurt] = parts[hurt].replace(b"payload", b"paxload", 1) if hurt % 2 else b"x" + parts[hurt][1:]
        found, gaps = salvaged(gzip.compress(b"".join(parts), mtime=0))
        assert found == names(*(k for k in range(6) if k != hurt))
        assert len(gaps) == 1 and gaps[0].endswith(f"{size} bytes at {begin} of the member's content")


def test_a_member_that_is_cut_or_has_a_wrong_checksum():
    for level in (0, 6):
        member = gzip.compress(b"".join(_records(6, False)), level, mtime=0)
        more = gzip.compress(_records(8, False)[7], mtime=0)
        for data in (member[:-8] + b"12345678", member[:-8], member[:-3]):
            found, gaps = salvaged(data + more)
            assert found == names(0, 1, 2, 3, 4, 5, 7) and len(gaps) == 1
        found, gaps = salvaged(member[: len(member) * 3 // 4] + more)
        assert found[-1:] == names(7) and found[:-1] == names(*range(len(found) - 1)) and gaps
    assert len(salvaged(member[:-20])[0]) >= 4
