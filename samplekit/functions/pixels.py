"""Kernels over stacks of images of one size: arrays of image, row, column and, if they have colours, channel. Borders mirror without repeating the edge (reflect-101)."""

from __future__ import annotations

import numpy as np


def reflect_pad(stack: np.ndarray, by: int) -> np.ndarray:
    return np.pad(stack, ((0, 0), (by, by), (by, by)) + ((0, 0),) * (stack.ndim - 3), mode="reflect" if min(stack.shape[1:3]) > by else "edge")


def filtered(stack: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with a square kernel."""
    k = kernel.shape[0] // 2
    padded = reflect_pad(stack.astype(np.float64), k)
    h, w = stack.shape[1:3]
    out = np.zeros(stack.shape, np.float64)
    for i, j in np.argwhere(kernel != 0):
        out += kernel[i, j] * padded[:, i : i + h, j : j + w]
    return out


LAPLACIAN = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)
SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
SHARPEN = np.array([[0, -1, 0], [-1, 5, -1], [0, -1, 0]], float)


def sharpening(lightness: float) -> np.ndarray:
    return np.array([[-1, -1, -1], [-1, 8 + lightness, -1], [-1, -1, -1]])


def embossing(strength: float) -> np.ndarray:
    return np.array([[-1 - strength, -strength, 0], [-strength, 1, strength], [0, strength, 1 + strength]])


def grayscale(stack: np.ndarray) -> np.ndarray:
    return stack if stack.ndim == 3 else np.floor(stack[..., :3] @ np.array([0.299, 0.587, 0.114]) + 0.5)


def quality_of(stack: np.ndarray) -> dict[str, np.ndarray]:
    """sharpness, contrast, mean_brightness and blur_score of images with values up to 255."""
    gray = grayscale(stack.astype(np.float64))
    inside = (1, 2)
    laplacian = filtered(gray, LAPLACIAN).var(axis=inside)
    gx, gy = filtered(gray, SOBEL), filtered(gray, SOBEL.T)
    energy = gx * gx + gy * gy
    return {
        "sharpness": 0.7 * laplacian + 0.3 * np.sqrt(energy).mean(axis=inside), "contrast": gray.std(axis=inside),
        "mean_brightness": gray.mean(axis=inside), "blur_score": (0.6 * laplacian + 0.4 * energy.var(axis=inside)) / 1000,
    }


def saturated(stack: np.ndarray) -> np.ndarray:
    """Whole numbers of 0 to 255, halves to even."""
    return np.clip(np.rint(stack), 0, 255)


def gaussian_kernel(sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    line = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    return np.outer(line, line) / line.sum() ** 2


def blurred(stack: np.ndarray, sigma: float) -> np.ndarray:
    return filtered(stack, gaussian_kernel(sigma))


def unsharp(stack: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    return saturated(1.5 * stack - 0.5 * blurred(stack, sigma))


def gamma_scaled(stack: np.ndarray, gamma: float = 1.2, factor: float = 1.1, shift: float = 5) -> np.ndarray:
    return saturated(np.abs(np.floor((stack / 255) ** (1 / gamma) * 255) * factor + shift))


def frame_sharpen(stack: np.ndarray) -> np.ndarray:
    """A mild sharpening, blended with the images."""
    return saturated(0.7 * stack + 0.3 * saturated(filtered(stack, 0.6 * SHARPEN)))


def _taps(new: int, old: int, reach: int, weight) -> np.ndarray:  # noqa: ANN001
    """Matrix of new rows by old columns: weights of the places around each new pixel's centre, a border's pixel standing for those beyond it."""
    at = (np.arange(new) + 0.5) * old / new - 0.5
    low = np.floor(at).astype(int)
    out = np.zeros((new, old))
    for k in range(1 - reach, reach + 1):
        np.add.at(out, (np.arange(new), np.clip(low + k, 0, old - 1)), weight(at - low - k))
    return out / out.sum(1, keepdims=True)


#: Kernels of resampling by distance from a centre, with the places on either side that they reach.
RESAMPLING = {"bilinear": (1, lambda t: 1 - np.abs(t)), "lanczos": (4, lambda t: np.sinc(t) * np.sinc(t / 4))}


def resized(stack: np.ndarray, height: int, width: int, method: str = "lanczos") -> np.ndarray:
    """Both axes as a product with a banded matrix. Lanczos looks at eight by eight places, also where it makes images smaller; its values can lie beyond those of the image."""
    rows, columns = (_taps(new, old, *RESAMPLING[method]) for new, old in ((height, stack.shape[1]), (width, stack.shape[2])))
    return np.einsum("yi,nij...,xj->nyx...", rows, stack.astype(np.float64), columns, optimize=True)


def to_hsv(stack: np.ndarray) -> np.ndarray:
    """Hue (0 to 6), saturation (0 to 1) and value of colours."""
    high, low = stack.max(-1), stack.min(-1)
    span = high - low
    safe = np.where(span > 0, span, 1)
    r, g, b = (stack[..., k] for k in range(3))
    hue = np.where(high == r, (g - b) / safe % 6, np.where(high == g, (b - r) / safe + 2, (r - g) / safe + 4))
    return np.stack([np.where(span > 0, hue, 0), np.where(high > 0, span / np.where(high > 0, high, 1), 0), high], -1)


def from_hsv(hsv: np.ndarray) -> np.ndarray:
    hue, saturation, value = (hsv[..., k] for k in range(3))
    place = (np.array([5, 3, 1]) + hue[..., None]) % 6
    return value[..., None] * (1 - saturation[..., None] * np.clip(np.minimum(place, 4 - place), 0, 1))


def shifted_hsv(stack: np.ndarray, hue: np.ndarray, saturation: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hue in steps of 2 degrees, saturation and value in steps of a 255th, of each image."""
    hsv = to_hsv(stack)
    over = lambda v: v.reshape(-1, 1, 1)
    parts = [(hsv[..., 0] + over(hue) / 30) % 6, np.clip(hsv[..., 1] + over(saturation) / 255, 0, 1), np.clip(hsv[..., 2] + over(value), 0, 255)]
    return saturated(from_hsv(np.stack(parts, -1)))


def line_kernel(size: int, angle: float) -> np.ndarray:
    """A line through the middle of a square, whose weights sum to 1."""
    out, middle = np.zeros((size, size)), size // 2
    along = np.linspace(-middle, middle, 4 * size)
    out[np.rint(middle + along * np.sin(angle)).astype(int), np.rint(middle + along * np.cos(angle)).astype(int)] = 1
    return out / out.sum()


def remapped(stack: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Images with the pixel that lies at (y, x) of each place, between pixels bilinear, beyond the border mirrored. y, x: images by height by width."""
    n, h, w = stack.shape[:3]

    def mirrored(at: np.ndarray, size: int) -> np.ndarray:
        period = max(1, 2 * (size - 1))
        at = np.abs(at) % period
        return np.minimum(at, period - at) if size > 1 else np.zeros_like(at)

    y, x = mirrored(y, h), mirrored(x, w)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    image = np.arange(n)[:, None, None]
    out = np.zeros(stack.shape, np.float64)
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            weight = wy * wx
            out += weight.reshape(*weight.shape, *(1,) * (stack.ndim - 3)) * stack[image, np.minimum(y0 + dy, h - 1), np.minimum(x0 + dx, w - 1)]
    return out


def equalised(gray: np.ndarray, clip: float, tiles: int = 8) -> np.ndarray:
    """Contrast-limited histogram equalisation of images of whole numbers up to 255: each tile's histogram is cut at clip times its mean, what is cut off is spread evenly, and the maps of the four tiles around a pixel are mixed by its distance from their middles."""
    n, h, w = gray.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(gray, ((0, 0), (0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric").astype(int)
    parts = padded.reshape(n, tiles, th, tiles, tw).transpose(0, 1, 3, 2, 4).reshape(n * tiles * tiles, th * tw)
    counts = np.zeros((len(parts), 256))
    np.add.at(counts, (np.arange(len(parts))[:, None], parts), 1)
    most = max(1.0, np.floor(clip * th * tw / 256))
    over = np.maximum(counts - most, 0).sum(1, keepdims=True)
    maps = (np.cumsum(np.minimum(counts, most) + over / 256, 1) * (255 / (th * tw))).reshape(n, tiles, tiles, 256)

    def around(size: int, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(size) + 0.5) / tile - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = around(h, th), around(w, tw)
    image, value = np.arange(n)[:, None, None], gray.astype(int)
    out = np.zeros(gray.shape)
    for ys, wy in ((y0, 1 - fy), (y1, fy)):
        for xs, wx in ((x0, 1 - fx), (x1, fx)):
            out += wy[:, None] * wx * maps[image, ys[:, None], xs, value]
    return saturated(out)


def median_filtered(stack: np.ndarray, size: int) -> np.ndarray:
    padded = reflect_pad(stack, size // 2)
    windows = np.lib.stride_tricks.sliding_window_view(padded, (size, size), axis=(1, 2))
    return np.median(windows, axis=(-2, -1))
