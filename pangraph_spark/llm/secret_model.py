"""A character convolutional network in numpy that tells secrets from other long tokens.

Input is a window of characters: the end of what precedes a candidate, a part of it, and the beginning of
what follows, each with its own marker channel; the part slides over longer candidates.  One convolution over embedded characters, max and mean
pooling, one hidden layer, one logit.  Labelled findings come from a table of the caller
(:func:`train_on`), or are made by rule from a seed: secrets of usual forms in code, configuration,
addresses and prose, and what is often mistaken for them.  The logit is calibrated by Platt scaling on a
part held out, and each kind's threshold is the largest that keeps the wanted recall on that part;
``held_out`` reports recall and false alarms there by kind.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEFT, BODY, RIGHT = 24, 40, 8
WIDTH = LEFT + BODY + RIGHT
CLASSES = 97  # printable ASCII, one class for the rest, one for padding
EMBED, FILTERS, SPAN, HIDDEN = 12, 24, 5, 16
HEX, ALNUM, B64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LOWER = "abcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "token")


def codes(text: str) -> list[int]:
    return [ord(c) - 31 if " " <= c <= "~" else 96 for c in text]


def window(left: str, body: str, right: str) -> np.ndarray:
    """Character classes of a candidate and its surroundings; 0 is padding."""
    out = np.zeros(WIDTH, np.int64)
    a, b, c = codes(left[-LEFT:]), codes(body[:BODY]), codes(right[:RIGHT])
    out[LEFT - len(a) : LEFT] = a
    out[LEFT : LEFT + len(b)] = b
    out[LEFT + BODY : LEFT + BODY + len(c)] = c
    return out


def labelled_findings(n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """``(kind, left, candidate, right, label)`` rows, half of them secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=k))
    word = lambda: "".join(pick(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ti", "is", "ou", "it"]) for _ in range(int(rng.integers(2, 6))))
    prose = lambda k: " ".join(word() for _ in range(k))
    names = ["password", "passwd", "secret", "token", "api_key", "apikey", "client_secret", "auth", "private_key", "bearer", "access_key", "credential"]
    out = []
    for k in range(n):
        kind = KINDS[k % 4]
        label = int(rng.random() < 0.5)
        right = pick(['"', "'", "\n", " ", ";", '"\n', ", ", "###"])
        if label:
            quote = pick(["", '"', "'"])
            left = prose(3) + pick(["\n", " ", ". "]) + pick(["", "export ", "const ", "db.", "AWS_"]) + pick(names) + pick(["=", " = ", ": ", ":", " => "]) + quote
            if kind == "assign":
                body = pick([chars(ALNUM, int(rng.integers(8, 40))), chars(HEX, pick([32, 40, 64])), word()[:5] + chars(ALNUM, 6)])
                if rng.random() < 0.2:
                    left, right = f"{prose(2)} {pick(['https', 'postgres', 'redis', 'amqp'])}://{word()}:", f"@{word()}.example.com/"
            elif kind == "access":
                body = "AKIA" + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
                left = pick([left, prose(4) + " "])
            elif kind == "hex":
                body = chars(HEX, pick([24, 32, 40, 64]))
            else:
                body = pick(["ghp_" + chars(ALNUM, 36), "sk_live_" + chars(ALNUM, 24), "xoxb-" + chars("0123456789", 12) + "-" + chars(ALNUM, 24), "eyJ" + chars(ALNUM, 30) + "." + chars(ALNUM, 40), base64.b64encode(rng.bytes(30)).decode(), chars(B64, int(rng.integers(24, 60))), "AIza" + chars(ALNUM, 35)])
                left = pick([left, left, prose(3) + " "])
                if rng.random() < 0.15:
                    body, left, right = chars(ALNUM[:52], int(rng.integers(16, 40))), pick([left, prose(2) + " = "]).rstrip('"\'') + '"', '"'
        else:
            left = prose(4) + pick([" ", ". ", "\n", " (", " \"", " see ", " at "])
            if kind == "assign":
                left = prose(2) + " " + pick(["password", "token", "secret"]) + pick([": ", "=", " = "])
                body = pick([word() + word(), "your-" + word() + "-here", "os.environ", "process.env." + word().upper(), "changeme", "example_" + word(), "None" + "." * 4, "get_" + word() + "_value", "<" + word()])
                if rng.random() < 0.2:
                    left, right, body = f"{prose(2)} {pick(['https', 'ftp', 'redis'])}://{word()}:", f"@{word()}.example.com/", pick(["password", "pass", "secret", "PASSWORD", "changeme", word(), "xxxxxxxx"])
            elif kind == "access":
                body = "AKIA" + pick(["EXAMPLE" * 3, "X" * 18, word().upper() + word().upper() + "NAMES" + "S" * 8])
            elif kind == "hex":
                left = prose(3) + pick([" commit ", " sha256:", " md5 ", " revision ", " color #", " checksum ", " etag "])
                body = pick([chars(HEX, pick([32, 40, 64])), pick(HEX) * 32, "deadbeef" * 4, "0123456789abcdef" * 2])
            else:
                body = pick([f"{word()}_{word()}_{word()}_{rng.integers(99)}", f"/usr/{word()}/{word()}/{word()}{rng.integers(9)}.so", f"{word()}.{rng.integers(99)}.{word()}.example.com", f"{word()}-{word()}-{rng.integers(2000, 2030)}-{rng.integers(1, 12)}-{rng.integers(1, 28)}", "".join(word().title() for _ in range(4)) + str(rng.integers(9)), f"{rng.integers(10**9)}.{rng.integers(10**9)}.{rng.integers(10**9)}", "=" * 24 + str(rng.integers(9)), "-".join(str(rng.integers(1000, 9999)) for _ in range(5)), f"{word()}={word()}={word()}={rng.integers(99)}"])
                if rng.random() < 0.3:
                    quote = pick(['"', "'"])
                    left, right = prose(4) + " " + quote, quote
                    body = pick([word() + word() + word(), word().title() + word().title() + word().title(), f"{word()}-{word()}-{word()}", f"{word()}_{word()}_{word()}", f"{word()}/{word()}.{word()}", word().upper() + "_" + word().upper()])
        out.append((kind, left, body, right, label))
    return out


@dataclass
class Network:
    """Weights by name, calibration ``p = 1 / (1 + exp(-(a * logit + b)))`` and a threshold per kind."""

    weights: dict[str, np.ndarray]
    a: float = 1.0
    b: float = 0.0
    thresholds: dict[str, float] | None = None
    held_out: dict[str, tuple[float, float]] | None = None  # recall and share of false alarms, by kind

    def forward(self, x: np.ndarray):
        w = self.weights
        e = w["embed"][x] + w["place"]
        cols = np.lib.stride_tricks.sliding_window_view(e, SPAN, axis=1)  # n, positions, EMBED, SPAN
        cols = cols.reshape(len(x), WIDTH - SPAN + 1, EMBED * SPAN)
        conv = np.maximum(cols @ w["conv"] + w["conv_bias"], 0)
        top = conv.argmax(axis=1)
        pooled = np.concatenate((np.take_along_axis(conv, top[:, None, :], 1)[:, 0], conv[:, LEFT : LEFT + BODY - SPAN + 1].mean(axis=1)), axis=1)
        hidden = np.maximum(pooled @ w["hidden"] + w["hidden_bias"], 0)
        return hidden @ w["out"] + w["out_bias"], (cols, conv, top, pooled, hidden)

    def largest(self, found, step: int = 4096) -> np.ndarray:
        """The largest probability of each ``(text, start, end)``: the body slides over all of it, its surroundings stay."""
        out = np.zeros(len(found))
        x, owner = [], []

        def flush() -> None:
            if x:
                np.maximum.at(out, owner, self.probability(np.array(x)))
                x.clear()
                owner.clear()

        for k, (text, a, b) in enumerate(found):
            for at in range(max(1, b - a - BODY + 1)):
                x.append(window(text[max(0, a - LEFT) : a], text[a + at : min(b, a + at + BODY)], text[b : b + RIGHT]))
                owner.append(k)
                if len(x) == step:
                    flush()
        flush()
        return out

    def probability(self, x: np.ndarray, step: int = 512) -> np.ndarray:
        parts = [self.forward(x[k : k + step])[0] for k in range(0, len(x), step)]
        logit = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.a * logit + self.b, -40, 40)))


def _start(rng) -> dict[str, np.ndarray]:
    normal = lambda scale, *shape: rng.normal(0, scale, shape)
    return {
        "embed": normal(0.3, CLASSES, EMBED), "place": normal(0.1, WIDTH, EMBED),
        "conv": normal((2 / (EMBED * SPAN)) ** 0.5, EMBED * SPAN, FILTERS), "conv_bias": np.zeros(FILTERS),
        "hidden": normal((1 / FILTERS) ** 0.5, 2 * FILTERS, HIDDEN), "hidden_bias": np.zeros(HIDDEN),
        "out": normal((1 / HIDDEN) ** 0.5, HIDDEN), "out_bias": np.zeros(1),
    }


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    w = net.weights
    logit, (cols, conv, top, pooled, hidden) = net.forward(x)
    g = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(x)
    out = {"out": hidden.T @ g, "out_bias": np.array([g.sum()])}
    gh = g[:, None] * w["out"] * (hidden > 0)
    out |= {"hidden": pooled.T @ gh, "hidden_bias": gh.sum(0)}
    gp = gh @ w["hidden"].T
    gc = np.zeros_like(conv)
    np.put_along_axis(gc, top[:, None, :], gp[:, None, :FILTERS], 1)
    inner = BODY - SPAN + 1
    gc[:, LEFT : LEFT + inner] += gp[:, None, FILTERS:] / inner
    gc *= conv > 0
    flat = gc.reshape(-1, FILTERS)
    out |= {"conv": cols.reshape(-1, EMBED * SPAN).T @ flat, "conv_bias": flat.sum(0)}
    ge = np.zeros((len(x), WIDTH, EMBED))
    back = (gc @ w["conv"].T).reshape(len(x), WIDTH - SPAN + 1, EMBED, SPAN)
    for k in range(SPAN):
        ge[:, k : k + WIDTH - SPAN + 1] += back[..., k]
    embed = np.zeros_like(w["embed"])
    np.add.at(embed, x, ge)
    return out | {"embed": embed, "place": ge.sum(0)}


def train(findings=None, epochs: int = 8, batch: int = 64, recall: float = 0.99, seed: int = 5) -> Network:
    """Fit on three quarters of the findings; calibrate and set thresholds on the rest."""
    findings = findings or labelled_findings()
    rng = np.random.default_rng(seed)
    x = np.array([window(a, b, c) for _, a, b, c, _ in findings])
    y = np.array([f[4] for f in findings], float)
    kind = np.array([f[0] for f in findings])
    order = rng.permutation(len(y))
    cut = len(y) * 3 // 4
    fit, rest = order[:cut], order[cut:]
    net = Network(_start(rng))
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    t = 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), batch):
            t += 1
            part = fit[at : at + batch]
            for k, g in _gradients(net, x[part], y[part]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.weights[k] -= 3e-3 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    logit = net.forward(x[rest])[0]
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt scaling by gradient steps
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))
        a -= 0.05 * ((p - y[rest]) * logit).mean()
        b -= 0.05 * (p - y[rest]).mean()
    net.a, net.b = float(a), float(b)
    p = net.probability(x[rest])
    net.thresholds, net.held_out = {}, {}
    for k in KINDS:
        mine, other = (np.sort(p[(y[rest] == label) & (kind[rest] == k)]) for label in (1, 0))
        least = net.thresholds[k] = float(mine[int((1 - recall) * len(mine))]) if len(mine) else 0.5
        net.held_out[k] = tuple(float((x >= least).mean()) if len(x) else float("nan") for x in (mine, other))
    return net


def train_on(findings: DataFrame, most: int = 20_000, **options) -> Network:
    """The network for a table ``kind, left_text, candidate, right_text, label`` of labelled findings.

    At most ``most`` rows are taken, by the order of their hashes; rows with nulls are left out.
    """
    rows = findings.select("kind", "left_text", "candidate", "right_text", F.col("label").cast("int").alias("label")).dropna()
    some = rows.orderBy(F.xxhash64(*rows.columns)).limit(most).collect()
    if not {0, 1} <= {r.label for r in some} or not {r.kind for r in some} <= set(KINDS):
        raise ValueError(f"findings of both labels and of the kinds {', '.join(KINDS)} are needed")
    return train([tuple(r) for r in some], **options)


_TRAINED: dict[tuple, Network] = {}


def trained(recall: float = 0.99, seed: int = 5) -> Network:
    """The network for the built-in findings, trained once a process."""
    if (recall, seed) not in _TRAINED:
        _TRAINED[recall, seed] = train(recall=recall, seed=seed)
    return _TRAINED[recall, seed]
