"""Synthetic frames and files for tests."""

import struct

import numpy as np


def star_field(w, h, n, background=1000.0, noise=25.0, peak=30000.0, sigma=1.5, seed=1, margin=20, dimmest=1.0):
    rng = np.random.default_rng(seed)
    img = background + rng.normal(0, noise, (h, w))
    y, x = np.mgrid[:h, :w]
    spots = []
    side = int(np.ceil(np.sqrt(n)))
    for k in range(n):  # on a jittered grid, so no two overlap
        cy = margin + (k // side + 0.5) * (h - 2 * margin) / side + rng.uniform(-2, 2)
        cx = margin + (k % side + 0.5) * (w - 2 * margin) / side + rng.uniform(-2, 2)
        spots.append((cy, cx))
        y0, x0 = int(cy), int(cx)
        s = np.s_[max(0, y0 - 12) : y0 + 13, max(0, x0 - 12) : x0 + 13]
        img[s] += peak * rng.uniform(dimmest, 1) * np.exp(-((y[s] - cy) ** 2 + (x[s] - cx) ** 2) / (2 * sigma**2))
    return img, spots


def pixels(spark, *frames):
    import pandas as pd

    parts = []
    for i, img in enumerate(frames):
        y, x = np.mgrid[: img.shape[0], : img.shape[1]]
        parts.append(pd.DataFrame({"frame_id": i, "y": y.ravel().astype("int64"), "x": x.ravel().astype("int64"), "r": img.ravel().astype(float)}))
    return spark.createDataFrame(pd.concat(parts))


def fits(img, cards=(), bitpix=-32):
    img = np.asarray(img)
    planes = img if img.ndim == 3 else img[None]
    kind = {-32: ">f4", 16: ">i2", 8: ">u1"}[bitpix]
    head = [("SIMPLE", "T"), ("BITPIX", str(bitpix)), ("NAXIS", str(img.ndim)), ("NAXIS1", str(planes.shape[2])), ("NAXIS2", str(planes.shape[1]))]
    if img.ndim == 3:
        head.append(("NAXIS3", str(planes.shape[0])))
    text = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in [*head, *cards]) + "END".ljust(80)
    body = planes[:, ::-1].astype(kind).tobytes()
    return text.ljust(-(-len(text) // 2880) * 2880).encode() + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def xisf(img, geometry=None, offset=4096, keywords=(), extra=""):
    img = np.asarray(img, "<f4")
    planes = img if img.ndim == 3 else img[None]
    geometry = geometry or f"{planes.shape[2]}:{planes.shape[1]}:{planes.shape[0]}"
    words = "".join(f'<FITSKeyword name="{k}" value="{v}" comment="c"/>' for k, v in keywords)
    space = "RGB" if len(planes) == 3 else "Gray"
    xml = f'<?xml version="1.0"?><xisf version="1.0" xmlns="http://www.pixinsight.com/xisf"><Image geometry="{geometry}" sampleFormat="Float32" colorSpace="{space}" location="attachment:{offset}:{img.nbytes}" {extra}>{words}</Image></xisf>'.encode()
    head = b"XISF0100" + struct.pack("<I", len(xml)) + bytes(4) + xml
    return head.ljust(4096, b"\0") + img.tobytes()
