"""Reading services for tests, a module of its own so that executors can load it."""

import time

from docproof.sources import reading


class Odd(reading.PlainPages):
    """Fails as the image says."""

    def extract(self, image, media_type):
        if image == b"slow":
            time.sleep(5)
        if image == b"late":
            raise TimeoutError("secret text")
        if image == b"down":
            raise reading.Unavailable("secret text")
        return super().extract(image, media_type)


class WholeOnly:
    def extract(self, image, media_type):
        return reading.PlainPages().extract(image, media_type)


class Ignored:
    """Has words without ids or boxes."""

    def extract(self, image, media_type):
        return reading.Page([reading.Word(*[None] * 9, t) for t in ("a", "a", "b")], 10, 10)


class Finer:
    """Reads what each plan asks for."""

    def extract(self, image, media_type):
        return reading.Page([], 1, 1)

    def extract_region(self, image, media_type, box, mode):
        texts = {50: "Stone & Hollow\nDistillery", 75: "Straight Bourbon Whiskey"}
        near = min(texts, key=lambda h: abs(h - box[3] / 2)) if mode == 6 else 75
        words, k = [], 0
        for row, line in enumerate(texts[near].split("\n")):
            for w in line.split():
                words.append(reading.Word(1, 1, 1, row, 10 + 100 * k, 10 + 60 * row, 18 * len(w), 40, 0.95, w))
                k += 1
        return reading.Page(words, 800, 150)
