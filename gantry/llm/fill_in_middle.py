"""Fill-in-middle transformation by overlapping chunks.

A unit is a word with the blanks before it, or the blanks that end a text.  A unit ends where a character and the
one after it say so: a character of a word that a blank or nothing follows, or a text's last blank.  Blanks are
ASCII, so bytes tell as much as characters do.

1. Texts are laid end to end and cut into chunks of ``CHUNK`` bytes, each of which also sees the byte after its
   last.  Unit ends and code points of all chunks are counted side by side by array operations, in blocks of
   ``BLOCK`` bytes, so a text of any length takes bounded working memory beside itself.
2. Running sums over the chunks give each text its number of units, and route the ranks of its two cuts to the
   chunks that own them.
3. Only those chunks are scanned again, to find the cuts.

Draws come from the SHA-256 of seed and ``doc_id``, so a repeated task gives the same rows.

Defined cases: a null text counts as empty and stays plain, as does a text that holds a marker.  A null ``doc_id``
draws like an empty one, rows with one id draw alike.  Other columns are not read, so their names cannot clash.
Rows repeated are transformed each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.llm.textbytes import BLANK, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 4096
BLOCK = 4 << 20


def edges(content: np.ndarray, first: int, after: int, ends: np.ndarray) -> np.ndarray:
    """Whether a unit ends with each byte of ``content[first:after]``, which is read one byte on; ``ends`` are the texts' ends therein."""
    blank = BLANK[content[first : after + 1]]
    followed = blank[1:] if len(blank) > after - first else np.append(blank[1:], True)
    edge = ~blank[: after - first] & followed
    edge[ends - 1 - first] = True
    return edge


def starts_character(content: np.ndarray) -> np.ndarray:
    return (content & 0xC0) != 0x80


class Chunks:
    """The chunks of texts that lie end to end in ``content``, the k-th up to ``ends[k]``, and the running sums over them."""

    def __init__(self, content: np.ndarray, ends: np.ndarray, chunk: int = CHUNK, block: int = BLOCK) -> None:
        self.content, self.ends = content, ends
        starts = np.concatenate(([0], ends[:-1]))
        per_text = -(-(ends - starts) // chunk)
        last = np.cumsum(per_text)
        number = np.arange(last[-1] if len(last) else 0) - np.repeat(last - per_text, per_text)
        self.first = np.repeat(starts, per_text) + number * chunk
        self.after = np.minimum(self.first + chunk, np.repeat(ends, per_text))
        self.before, self.last = last - per_text, last  # of each text, its chunks
        counts, characters = np.zeros(len(self.first) + 1, np.int64), np.zeros(len(self.first) + 1, np.int64)
        step = max(1, block // chunk)
        for a in range(0, len(self.first), step):
            b = min(a + step, len(self.first))
            lo, hi = int(self.first[a]), int(self.after[b - 1])
            at = self.first[a:b] - lo
            counts[a + 1 : b + 1] = np.add.reduceat(edges(content, lo, hi, self._ends(lo, hi)), at, dtype=np.int64)
            characters[a + 1 : b + 1] = np.add.reduceat(starts_character(content[lo:hi]), at, dtype=np.int64)
        self.units, self.characters = np.cumsum(counts), np.cumsum(characters)

    def _ends(self, lo: int, hi: int) -> np.ndarray:
        """Ends of texts within (lo, hi]."""
        return self.ends[np.searchsorted(self.ends, lo, "right") : np.searchsorted(self.ends, hi, "right")]

    def sizes(self) -> np.ndarray:
        """Units of each text."""
        return self.units[self.last] - self.units[self.before]

    def cut(self, text: int, rank: int, owner: int) -> tuple[int, int]:
        """Where the ``rank``-th unit of a text ends: byte in ``content``, and code points of the text before it."""
        start = int(self.ends[text - 1]) if text else 0
        if rank == 0:
            return start, 0
        lo, hi = int(self.first[owner]), int(self.after[owner])
        within = rank + self.units[self.before[text]] - self.units[owner]
        at = lo + int(np.flatnonzero(edges(self.content, lo, hi, self._ends(lo, hi)))[within - 1]) + 1
        passed = self.characters[owner] - self.characters[self.before[text]]
        return at, int(passed + np.count_nonzero(starts_character(self.content[lo:at])))

    def owners(self, ranks: np.ndarray) -> np.ndarray:
        """Of each text, the chunk in which its unit of that rank ends; of no meaning for rank 0."""
        return np.searchsorted(self.units[1:], self.units[self.before] + ranks, "left")


def _laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each ends."""
    flat = pc.fill_null(texts, "").cast(pa.large_binary())
    flat = pa.concat_arrays([flat]) if flat.offset else flat
    _, ends, content = flat.buffers()
    ends = np.frombuffer(ends, np.int64)[1 : len(flat) + 1] if len(flat) else np.empty(0, np.int64)
    return (np.frombuffer(content, np.uint8) if content is not None and content.size else np.empty(0, np.uint8)), ends


def _transformed(batches: Iterator[pa.RecordBatch], chunk: int, block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            content, ends = _laid_out(part.column("text"))
            chunks = Chunks(content, ends, chunk, block)
            n = chunks.sizes()
            draws = np.stack([part.column(c).to_numpy(zero_copy_only=False) % (n + 1) for c in ("h1", "h2")])
            ranks = np.sort(draws, axis=0)
            owners = [chunks.owners(r) for r in ranks]
            prefix, middle, out = [], [], []
            for k, form in enumerate(part.column("form").to_pylist()):
                start, end = int(ends[k - 1]) if k else 0, int(ends[k])
                if form == "plain":
                    prefix.append(None)
                    middle.append(None)
                    out.append(content[start:end].tobytes())
                    continue
                (a, a_chars), (b, b_chars) = (chunks.cut(k, int(r[k]), int(o[k])) for r, o in zip(ranks, owners, strict=True))
                prefix.append(a_chars)
                middle.append(b_chars - a_chars)
                pieces = {PREFIX: content[start:a], MIDDLE: content[a:b], SUFFIX: content[b:end]}
                order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
                out.append(b"".join(x for marker in order for x in (marker.encode(), pieces[marker].tobytes())))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n": pa.array(n, pa.int64()),
                    "form": part.column("form"),
                    "prefix_chars": pa.array(prefix, pa.int64()),
                    "middle_chars": pa.array(middle, pa.int64()),
                    "output": pa.array(out, pa.binary()).cast(pa.string()),
                }
            )


def _draw(seed: int, number: int) -> Column:
    """The ``number``-th group of eight hex digits of the SHA-256 of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """``doc_id, n`` (units), ``form`` (plain, psm or spm), ``prefix_chars, middle_chars, output`` of every text.

    ``percent`` of the texts are transformed, ``spm_percent`` of these with the suffix first.
    """
    text = F.coalesce("text", F.lit(""))
    marked = [F.contains(text, F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (text == "") | marked[0] | marked[1] | marked[2] | (_draw(seed, 3) % 100 >= percent)
    form = F.when(plain, "plain").when(_draw(seed, 4) % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), _draw(seed, 1).alias("h1"), _draw(seed, 2).alias("h2"), form.alias("form"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(lambda batches: _transformed(batches, chunk, block), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from output and form alone."""
    before = lambda marker: F.substring_index(output, marker, 1)
    behind = lambda marker: F.substring_index(output, marker, -1)
    inner = lambda a, b: F.substring_index(behind(a), b, 1)
    psm = F.concat(F.substring_index(before(SUFFIX), PREFIX, -1), behind(MIDDLE), inner(SUFFIX, MIDDLE))
    spm = F.concat(inner(PREFIX, MIDDLE), behind(MIDDLE), F.substring_index(before(PREFIX), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(transformed: DataFrame) -> DataFrame:
    """Digests in place of the output, and of the text restored from it."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    again = sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), again)


def oracle_sql(seed: int = 42, percent: int = 50, spm_percent: int = 80) -> str:
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('{seed}:' || doc_id) AS d,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
h AS (
  SELECT doc_id, x, u, len(u)::BIGINT AS n,
         ('0x' || substr(d, 1, 8))::BIGINT % (len(u) + 1) AS p, ('0x' || substr(d, 9, 8))::BIGINT % (len(u) + 1) AS q,
         CASE WHEN x = '' OR contains(x, '{PREFIX}') OR contains(x, '{SUFFIX}') OR contains(x, '{MIDDLE}')
                OR ('0x' || substr(d, 17, 8))::BIGINT % 100 >= {percent} THEN 'plain'
              WHEN ('0x' || substr(d, 25, 8))::BIGINT % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form
  FROM t),
c AS (
  SELECT *, array_to_string(u[1:least(p, q)], '') AS pre, array_to_string(u[least(p, q) + 1:greatest(p, q)], '') AS mid,
         array_to_string(u[greatest(p, q) + 1:n], '') AS suf
  FROM h)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
                        ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM c
"""
