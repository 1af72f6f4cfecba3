"""Image kernels in numpy, for what has no form in SQL: edges, masks, components, filters, geometry.

Images are arrays of height x width x 3 bytes in the order blue, green, red; gray planes are height x width bytes.
Results follow common definitions of these filters; scores agree with other libraries to their buckets, not bit by bit.
"""

from __future__ import annotations

import struct

import numpy as np


def gray(image: np.ndarray) -> np.ndarray:
    b, g, r = (image[..., k].astype(np.float64) for k in range(3))
    return np.clip(np.rint(0.299 * r + 0.587 * g + 0.114 * b), 0, 255).astype(np.uint8)


def hsv(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue 0 to 179, saturation and value 0 to 255."""
    x = image.astype(np.float64)
    top, least = x.max(axis=2), x.min(axis=2)
    span = np.where(top > least, top - least, 1.0)
    b, g, r = x[..., 0], x[..., 1], x[..., 2]
    hue = np.where(top == r, (g - b) / span % 6, np.where(top == g, (b - r) / span + 2, (r - g) / span + 4))
    return np.where(top > least, np.rint(hue * 30) % 180, 0), np.where(top > 0, np.rint(255 * (top - least) / np.maximum(top, 1)), 0), top


def _windows(x: np.ndarray, ry: int, rx: int, mode: str) -> np.ndarray:
    padded = np.pad(x, ((ry, ry), (rx, rx)), mode=mode)
    return np.lib.stride_tricks.sliding_window_view(padded, (2 * ry + 1, 2 * rx + 1))


def dilate(mask: np.ndarray, size: int, times: int = 1) -> np.ndarray:
    for _ in range(times):
        r = size // 2
        p = np.pad(mask, r)
        rows = np.maximum.reduce([p[:, k : k + mask.shape[1]] for k in range(size)])
        mask = np.maximum.reduce([rows[k : k + mask.shape[0]] for k in range(size)])
    return mask


def laplacian(plane: np.ndarray) -> np.ndarray:
    p = np.pad(plane.astype(np.float64), 1, mode="reflect" if min(plane.shape) > 1 else "edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def blur(x: np.ndarray, sigma: float, size: int = 0) -> np.ndarray:
    """Gaussian blur, rows then columns, with reflected borders; without a size it spans three sigmas."""
    r = size // 2 if size else max(1, round(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    f = x.astype(np.float64)
    for axis in (0, 1):
        width = [(0, 0)] * f.ndim
        width[axis] = (r, r)
        p = np.pad(f, width, mode="reflect" if f.shape[axis] > r else "edge")
        n = f.shape[axis]
        f = sum(w * np.take(p, range(j, j + n), axis=axis) for j, w in enumerate(k))
    return np.clip(np.rint(f), 0, 255).astype(np.uint8)


def canny(plane: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: Sobel gradients (sum of both), thinned across their direction; weak ones stay where they touch strong ones."""
    p = np.pad(plane.astype(np.float64), 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    m = np.abs(gx) + np.abs(gy)
    q = np.pad(m, 1)
    at = lambda dy, dx: q[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]]
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay <= ax * np.tan(np.pi / 8), ay >= ax * np.tan(3 * np.pi / 8)
    same = gx * gy > 0
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    behind = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    thin = (m > before) & (m >= behind)
    weak, strong = thin & (m > low), thin & (m > high)
    labels, n = components(weak)
    keep = np.zeros(n + 1, bool)
    keep[np.unique(labels[strong])] = True
    keep[0] = False
    return keep[labels]


def components(mask: np.ndarray, corners: bool = True) -> tuple[np.ndarray, int]:
    """Labels 1..n of connected parts: runs of each row, linked to the runs above, then merged by least label.

    Pixels that meet at a corner only are connected (8 neighbours), or with ``corners`` off they are not (4 neighbours).
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    n = len(row)
    if not n:
        return np.zeros((h, w), np.int64), 0
    first = np.searchsorted(row, np.arange(h + 1))
    key = row * (w + 2)
    # a run touches those of the row above that begin at its end + 1 or before and end at its begin - 1 or after
    lo = np.maximum(np.searchsorted(key + b, (row - 1) * (w + 2) + a, side="left" if corners else "right"), first[np.maximum(row - 1, 0)])
    hi = np.minimum(np.searchsorted(key + a, (row - 1) * (w + 2) + b, side="right" if corners else "left"), first[row])
    many = np.where(row > 0, np.maximum(hi - lo, 0), 0)
    i = np.repeat(np.arange(n), many)
    j = np.repeat(lo, many) + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
    root = np.arange(n)
    while True:
        x, y = root[i], root[j]
        if not (open_ := x != y).any():
            break
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while not np.array_equal(up := root[root], root):
            root = up
    _, number = np.unique(root, return_inverse=True)
    labels = np.zeros(h * w, np.int64)
    size = b - a
    at = np.repeat(row * w + a, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    labels[at] = np.repeat(number + 1, size)
    return labels.reshape(h, w), int(number.max()) + 1


def boxes(labels: np.ndarray, n: int) -> np.ndarray:
    """Rows (x, y, width, height, area) of the parts."""
    y, x = np.nonzero(labels)
    k = labels[y, x] - 1
    out = np.zeros((n, 5), np.int64)
    low = np.full((2, n), 1 << 30)
    high = np.zeros((2, n), np.int64)
    for axis, v in enumerate((x, y)):
        np.minimum.at(low[axis], k, v)
        np.maximum.at(high[axis], k, v)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = low[0], low[1], high[0] - low[0] + 1, high[1] - low[1] + 1
    out[:, 4] = np.bincount(k, minlength=n)
    return out


def histogram(plane: np.ndarray) -> np.ndarray:
    """Pixels at each of the 256 levels."""
    return np.bincount(plane.ravel(), minlength=256)


def brightness(plane: np.ndarray) -> float:
    return float(plane.mean())


def otsu(plane: np.ndarray) -> tuple[int, float, float]:
    """(threshold, eta, contrast) of a gray plane; (0, 0, 0) if it has one level only."""
    n = histogram(plane).astype(np.float64)
    n /= max(1.0, n.sum())
    levels = np.arange(256)
    w0, m = np.cumsum(n), np.cumsum(n * levels)
    mean = m[-1]
    variance = (n * (levels - mean) ** 2).sum()
    good = (w0 > 1e-12) & (w0 < 1 - 1e-12)
    if variance <= 1e-9 or not good.any():
        return 0, 0.0, 0.0
    gap = np.zeros(256)
    gap[good] = (mean - m[good]) / (1 - w0[good]) - m[good] / w0[good]
    between = w0 * (1 - w0) * gap**2
    best = int(np.argmax(between))
    return best, float(between[best] / variance), float(abs(gap[best]))


def text_mask(plane: np.ndarray) -> np.ndarray:
    return dilate(canny(plane, 60, 160), 3)


def sharpness(plane: np.ndarray, mask: np.ndarray) -> float:
    """Variance of the Laplacian on the strokes; 0 where there are fewer than 20 pixels of them."""
    return float(laplacian(plane)[mask].var()) if mask.sum() >= 20 else 0.0


def glare(image: np.ndarray) -> float:
    """Share of bright, pale pixels well above the mean value; 0 for plain white pages."""
    _, s, v = hsv(image)
    return 0.0 if v.std() < 25 and v.mean() > 200 else float(((v > 250) & (s < 20) & (v > v.mean() + 35)).mean())


def measure(image: np.ndarray) -> dict[str, float]:
    """The measured values of an image (see schemas.METRICS); scoring is done in SQL."""
    plane = gray(image)
    h, w = plane.shape
    mask = text_mask(plane)
    _, eta, contrast = otsu(plane)
    return {
        "width": w, "height": h, "sharpness": sharpness(plane, mask), "contrast": contrast, "eta": eta, "char_height": char_height(plane),
        "density": float(mask.mean()), "reflection": glare(image), "brightness": brightness(plane),
    }


def char_height(plane: np.ndarray) -> float:
    h, w = plane.shape
    my, mx = int(h * 0.08), int(w * 0.08)
    crop = plane[my : h - my, mx : w - mx]
    if not crop.size:
        return 0.0
    level, eta, _ = otsu(crop)
    labels, n = components(crop <= level) if eta else (None, 0)
    if not n:
        return 0.0
    _, _, bw, bh, area = boxes(labels, n).T
    return median_height(bw, bh, area, crop.size)


def median_height(bw: np.ndarray, bh: np.ndarray, area: np.ndarray, whole: int) -> float:
    """Median height of the 200 largest parts that look like characters, 0 without any; ties in area keep the order.

    bw, bh, area: width, height and pixels of each part; whole: pixels of the image.
    """
    ratio = bw / np.maximum(bh, 1)
    ok = (area <= whole * 0.02) & (bh >= 3) & (bw >= 2) & (ratio >= 0.15) & (ratio <= 6) & (area / np.maximum(bw * bh, 1) >= 0.15)
    if not ok.any():
        return 0.0
    return float(np.median(bh[ok][np.argsort(-area[ok], kind="stable")[:200]]))


# ---------------------------------------------------------------- preprocessing


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means over source areas when shrinking, cubic interpolation when growing."""
    def weights(n: int, m: int) -> np.ndarray:
        scale = n / m
        out = np.zeros((m, n))
        if scale > 1:
            for k in range(m):
                a, b = k * scale, (k + 1) * scale
                at = np.arange(int(a), min(n, int(np.ceil(b))))
                out[k, at] = np.minimum(at + 1, b) - np.maximum(at, a)
            return out / out.sum(axis=1, keepdims=True)
        x = (np.arange(m) + 0.5) * scale - 0.5
        base = np.floor(x).astype(int)
        for d in range(-1, 3):
            t = np.abs(x - base - d)
            cubic = np.where(t <= 1, 1.25 * t**3 - 2.25 * t**2 + 1, -0.75 * t**3 + 3.75 * t**2 - 6 * t + 3)
            np.add.at(out, (np.arange(m), np.clip(base + d, 0, n - 1)), cubic)
        return out

    rows, cols = weights(image.shape[0], height), weights(image.shape[1], width)
    out = np.einsum("yh,hwc->ywc", rows, image.astype(np.float64))
    return np.clip(np.rint(np.einsum("xw,ywc->yxc", cols, out)), 0, 255).astype(np.uint8)


def target_size(w: int, h: int, low: int, high: int) -> tuple[int, int]:
    """Width and height after scaling into the range of widths; fractions are cut off."""
    scale = (low if w < low else high if w > high else w) / w
    return int(w * scale), int(h * scale)


def resize_if_needed(image: np.ndarray, low: int = 1200, high: int = 1600) -> np.ndarray:
    h, w = image.shape[:2]
    return image if low <= w <= high else resize(image, *target_size(w, h, low, high))


def fitted_size(w: int, h: int, most: int) -> tuple[int, int]:
    """Width and height after shrinking so that the longest side is at most so long; fractions are cut off."""
    scale = most / max(h, w)
    return (max(1, int(w * scale)), max(1, int(h * scale))) if scale < 1 else (w, h)


def fit_side(image: np.ndarray, most: int = 960) -> np.ndarray:
    h, w = image.shape[:2]
    size = fitted_size(w, h, most)
    return image if size == (w, h) else resize(image, *size)


def denoise(image: np.ndarray) -> np.ndarray:
    return blur(image, 0.8, 3)


def unsharp(image: np.ndarray, strength: float = 1.5, sigma: float = 1.0) -> np.ndarray:
    soft = blur(image, sigma).astype(np.float64)
    return np.clip(np.rint(image * (1.0 + strength) - soft * strength), 0, 255).astype(np.uint8)


_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


_SRGB = np.arange(256) / 255.0
#: Light of each level.
_LIGHT = np.where(_SRGB <= 0.04045, _SRGB / 12.92, ((_SRGB + 0.055) / 1.055) ** 2.4)


def _lab(image: np.ndarray) -> np.ndarray:
    c = _LIGHT[image[..., ::-1]]
    t = c @ _TO_XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack((116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])), -1)


def _from_lab(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] + 16) / 116
    f = np.stack((fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200), -1)
    t = np.where(f > 6 / 29, f**3, (f - 16 / 116) / 7.787) * _WHITE
    c = np.clip(t @ np.linalg.inv(_TO_XYZ).T, 0, 1)
    c = np.where(c <= 0.0031308, 12.92 * c, 1.055 * c ** (1 / 2.4) - 0.055)
    return np.clip(np.rint(c[..., ::-1] * 255), 0, 255).astype(np.uint8)


def equalize_tiles(plane: np.ndarray, clip: float = 2.5, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalization by tiles, with maps interpolated between the tiles' centres."""
    h, w = plane.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(plane, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if h >= th * tiles - h and w >= tw * tiles - w else "edge")
    limit = max(1, int(clip * th * tw / 256))
    maps = np.zeros((tiles, tiles, 256))
    for a in range(tiles):
        for b in range(tiles):
            n = np.bincount(p[a * th : (a + 1) * th, b * tw : (b + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            rest = over % 256
            if rest:
                n[:: max(1, 256 // rest)][:rest] += 1
            maps[a, b] = np.clip(np.rint(np.cumsum(n) * 255.0 / (th * tw)), 0, 255)

    def near(n: int, t: int):
        f = (np.arange(n) + 0.5) / t - 0.5
        low = np.floor(f).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), f - low

    y0, y1, fy = near(h, th)
    x0, x1, fx = near(w, tw)
    v = plane.astype(int)
    at = lambda ys, xs: maps[ys[:, None], xs[None, :], v]
    fy, fx = fy[:, None], fx[None, :]
    out = (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def enhance_contrast(image: np.ndarray) -> np.ndarray:
    lab = _lab(image)
    light = np.clip(np.rint(lab[..., 0] * 2.55), 0, 255).astype(np.uint8)
    lab[..., 0] = equalize_tiles(light) / 2.55
    return _from_lab(lab)


def outer_parts(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(boxes, areas) of the outermost parts, each with the area inside the outline through its pixels' centres.

    What is not joined to the border by its four sides lies inside a part: holes are filled, and parts in them vanish.
    """
    ground, _ = components(np.pad(~mask, 1, constant_values=True), corners=False)
    filled = (ground != ground[0, 0])[1:-1, 1:-1]
    labels, n = components(filled)
    if not n:
        return np.zeros((0, 5), np.int64), np.zeros(0)
    corner = np.stack([labels[:-1, :-1], labels[:-1, 1:], labels[1:, :-1], labels[1:, 1:]])
    inside = (corner > 0).sum(axis=0)  # all pixels of a square of 2 x 2 are of one part, as they touch
    squares = np.where(inside == 4, 1.0, np.where(inside == 3, 0.5, 0.0))
    return boxes(labels, n), np.bincount(corner.max(axis=0).ravel(), squares.ravel(), minlength=n + 1)[1:]


# Aspect ratios of documents.
RATIOS = (1.42, 0.70, 1.58, 1.0, 0.63)


def best_crop(found: np.ndarray, area: np.ndarray, w: int, h: int) -> tuple[int, int, int, int, float] | None:
    """(x1, y1, x2, y2, score): box of the part most like a document, with 2 % around it; none if no score reaches 0.40.

    found: rows that begin with x, y, width, height; area: of each outline; w, h: of the image. The 15 largest are
    looked at; ties in area keep the order, and of equal scores the first counts.
    """
    best = None
    for k in np.argsort(-area, kind="stable")[:15]:
        x, y, cw, ch = (int(v) for v in found[k][:4])
        share = area[k] / (h * w)
        if not 0.03 <= share <= 0.85 or cw < w * 0.1 or ch < h * 0.1:
            continue
        aspect = max(cw, ch) / max(min(cw, ch), 1)
        score = max(1 / (1 + abs(aspect - r)) for r in RATIOS) * (area[k] / max(cw * ch, 1)) * min(share / 0.10, 1.0)
        if score >= 0.40 and (best is None or score > best[4]):
            px, py = int(cw * 0.02), int(ch * 0.02)
            best = max(0, x - px), max(0, y - py), min(w, x + cw + px), min(h, y + ch + py), float(score)
    return best


def crop_document(image: np.ndarray) -> np.ndarray:
    """Cut to the part most like a document; whole if none is good enough."""
    h, w = image.shape[:2]
    best = best_crop(*outer_parts(dilate(canny(blur(gray(image), 1.1, 5), 30, 100), 5, 2)), w, h)
    if best is None:
        return image
    x1, y1, x2, y2, _ = best
    return image[y1:y2, x1:x2]


def level_segments(edges: np.ndarray, most: float = 15.0, votes: int = 100, gap: int = 20) -> np.ndarray:
    """Rows (x1, y1, x2, y2) of line segments within ``most`` degrees of level, by a Hough transform over all edge points.

    Each line of whole degrees and whole pixels with enough votes is tried, the one with the most votes first. Its points are cut
    where the gap is too wide; runs of at least a sixth of the width are segments, and their points count for no other.
    """
    y, x = np.nonzero(edges)
    angles = np.radians(np.arange(-np.floor(most), np.floor(most) + 1))
    lines = []
    for a in angles:
        rho = np.rint(y * np.cos(a) - x * np.sin(a)).astype(np.int64)
        low = int(rho.min()) if len(rho) else 0
        n = np.bincount(rho - low)
        enough = np.flatnonzero(n >= votes)
        lines += [(-int(n[k]), float(a), int(k) + low) for k in enough[long_runs(edges, float(a), enough + low, gap)]]
    free, out = np.ones(edges.shape, bool), []
    for _, a, rho in sorted(lines, key=lambda line: (line[0], abs(line[1]), line[1], line[2])):
        # the line's pixels and those beside it, column by column
        at = np.arange(edges.shape[1])
        base = np.rint((rho + at * np.sin(a)) / np.cos(a)).astype(np.int64)
        rows = base[None, :] + np.arange(-1, 2)[:, None]
        there = (rows >= 0) & (rows < edges.shape[0])
        rows = np.clip(rows, 0, edges.shape[0] - 1)
        hit = there & edges[rows, at[None, :]] & free[rows, at[None, :]]
        cols = np.flatnonzero(hit.any(axis=0))
        if len(cols) < 2:
            continue
        for run in np.split(cols, np.flatnonzero(np.diff(cols) > gap) + 1):
            if run[-1] - run[0] < edges.shape[1] // 6 or len(run) < 2:
                continue
            mean = [float(rows[:, c][hit[:, c]].mean()) for c in (run[0], run[-1])]
            out.append((float(run[0]), mean[0], float(run[-1]), mean[1]))
            own = np.zeros(edges.shape[1], bool)
            own[run] = True
            k, c = np.nonzero(hit & own)
            free[rows[k, c], c] = False
    return np.array(out).reshape(-1, 4)


def long_runs(edges: np.ndarray, a: float, rho: np.ndarray, gap: int, block: int = 256) -> np.ndarray:
    """Whether each line of an angle has a run of a sixth of the width at all, with no point taken by other lines yet."""
    h, w = edges.shape
    out, at = np.zeros(len(rho), bool), np.arange(w)
    for k in range(0, len(rho), block):
        base = np.rint((rho[k : k + block, None] + at * np.sin(a)) / np.cos(a)).astype(np.int64)
        hit = np.zeros(base.shape, bool)
        for d in (-1, 0, 1):
            rows = base + d
            hit |= (rows >= 0) & (rows < h) & edges[np.clip(rows, 0, h - 1), at[None, :]]
        line, col = np.nonzero(hit)
        if len(line):
            cut = np.flatnonzero((np.diff(line) != 0) | (np.diff(col) > gap))
            first, last = np.append(0, cut + 1), np.append(cut, len(line) - 1)
            out[k + line[first[(last > first) & (col[last] - col[first] >= w // 6)]]] = True
    return out


def median_angle(segments: np.ndarray, most: float = 15.0) -> float:
    """Median angle, in degrees, of the segments that are nearly level; 0 if it is below 0.3 or there are none."""
    x1, y1, x2, y2 = segments.T
    angle = np.degrees(np.arctan2(y2 - y1, x2 - x1))[x2 != x1]
    angle = angle[np.abs(angle) < most]
    middle = float(np.median(angle)) if len(angle) else 0.0
    return middle if abs(middle) >= 0.3 else 0.0


def skew_angle(plane: np.ndarray, most: float = 15.0) -> float:
    return median_angle(level_segments(canny(plane, 50, 150), most), most)


def rotate(image: np.ndarray, angle: float) -> np.ndarray:
    """Turn by an angle in degrees about the centre, on a white canvas that holds all of it."""
    h, w = image.shape[:2]
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    nw, nh = int(h * abs(s) + w * abs(c)), int(h * abs(c) + w * abs(s))
    yy, xx = np.mgrid[0:nh, 0:nw]
    dx, dy = xx - nw / 2, yy - nh / 2
    sx, sy = c * dx - s * dy + w // 2, s * dx + c * dy + h // 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    p = np.pad(image.astype(np.float64), ((1, 1), (1, 1), (0, 0)), constant_values=255)

    def at(y, x):
        return p[np.clip(y + 1, 0, h + 1), np.clip(x + 1, 0, w + 1)]

    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def deskew(image: np.ndarray, most: float = 15.0) -> np.ndarray:
    angle = skew_angle(gray(image), most)
    return rotate(image, angle) if angle else image


def preprocess(image: np.ndarray, sharpness_score: int | None, contrast_score: int | None, config) -> np.ndarray:
    """Crop, resize, smooth, enhance by what the scores ask for, and set level. A missing score skips its step."""
    if config.fast_mode:
        return image
    image = resize_if_needed(crop_document(image), config.resize_min, config.resize_max)
    image = denoise(image)
    if contrast_score is not None and contrast_score < config.contrast_threshold:
        image = enhance_contrast(image)
    if sharpness_score is not None and sharpness_score < config.sharpness_threshold:
        image = unsharp(image)
    return deskew(image, config.max_deskew)


def colour_masks(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values): what is blue, and what is dark, as black on white."""
    h, s, v = hsv(image)
    blue = (h >= 80) & (h <= 130) & (s >= 50) & (v >= 50)
    out = [np.where(m, 0, 255).astype(np.uint8) for m in (blue, v <= 90)]
    return tuple(np.repeat(m[..., None], 3, axis=2) for m in out)


# ---------------------------------------------------------------- orientation


def orientation(data: bytes) -> int:
    """EXIF orientation of a JPEG file; 1 if there is none."""
    if data[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4])
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            tiff = data[at + 10 : at + 2 + size]
            order = "<" if tiff[:2] == b"II" else ">"
            try:
                start = struct.unpack_from(order + "I", tiff, 4)[0]
                for k in range(struct.unpack_from(order + "H", tiff, start)[0]):
                    tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, start + 2 + 12 * k)
                    if tag == 0x0112:
                        return value if 1 <= value <= 8 else 1
            except struct.error:
                return 1
        at += 2 + size
    return 1


def upright(image: np.ndarray, how: int) -> np.ndarray:
    """The image as its orientation says."""
    turn = {1: lambda x: x, 2: np.fliplr, 3: lambda x: np.rot90(x, 2), 4: np.flipud, 5: lambda x: x.swapaxes(0, 1), 6: lambda x: np.rot90(x, -1), 7: lambda x: np.rot90(x, 2).swapaxes(0, 1), 8: np.rot90}
    return np.ascontiguousarray(turn.get(how, turn[1])(image))
