"""Row-at-a-time forms of the detectors, used only to check the parallel ones."""

import hashlib
import statistics


def eddm_rows(oks, warning=0.95, drift=0.90, min_errors=50):
    out, distances, last, best = [], [], 0, 0.0
    for n, ok in enumerate(oks, 1):
        ratio = None
        if not ok:
            distances.append(n - last)
            last = n
            if len(distances) > 1:
                c = statistics.fmean(distances) + 2 * statistics.stdev(distances)
                best = max(best, c)
                if len(distances) >= min_errors:
                    ratio = c / best
        status = "normal" if ratio is None or ratio >= warning else "drift" if ratio < drift else "warning"
        mean = statistics.fmean(distances) if distances else 0.0
        out.append((n, status, ratio, len(distances), mean, best))
    return out


def thinned(positions, gap, last=None):
    kept = []
    for p in sorted(positions):
        if last is None or p - last >= gap:
            kept.append(p)
            last = p
    return kept


def draw(pos, seed=42):
    return int(hashlib.md5(f"{seed}:{pos}".encode()).hexdigest()[:15], 16)


def ks_h(a, b):
    points = sorted({*a, *b})
    return max(abs(sum(x <= v for x in a) - sum(x <= v for x in b)) for v in points)


def kswin_drifts(values, reference, current, least, seed=42):
    """Queue form with restarts: [(position, h)] of the drifts."""
    window, drifts = [], []
    for pos, v in enumerate(values, 1):
        window = (window + [(pos, v)])[-(reference + current):]
        if len(window) < reference + current:
            continue
        old, new = window[:reference], window[reference:]
        sample = sorted(old, key=lambda r: (draw(r[0], seed), r[0]))[:current]
        h = ks_h([v for _, v in sample], [v for _, v in new])
        if h >= least:
            drifts.append((pos, h))
            window = new
    return drifts
