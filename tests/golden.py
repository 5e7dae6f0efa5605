"""Plain sequential references (numpy) used as goldens."""

import numpy as np

from factorcast import config


def init_vec(i, k, salt, scale):
    j = np.arange(k, dtype=np.int64)
    u = ((i * config.INIT_ID_MULT + j * config.INIT_J_MULT + salt) % config.INIT_MOD) / float(config.INIT_MOD)
    return np.sqrt(u * scale / float(k))


def dot(a, b):
    s = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        s += x * y
    return s


class SeqModel:
    """Sequential SGD on two dicts, exactly as the online programs do."""

    def __init__(self, k, scale=config.SCALE_EXPLICIT):
        self.k, self.scale = k, scale
        self.u, self.p = {}, {}

    def _get(self, d, i, salt):
        v = d.get(i)
        return init_vec(i, self.k, salt, self.scale) if v is None else v

    def step(self, user, product, rating, steps, gu, gi, lam):
        for _ in range(steps):
            uf = self._get(self.u, user, config.USER_SALT)
            pf = self._get(self.p, product, config.PRODUCT_SALT)
            e = rating - dot(uf, pf)
            self.u[user] = uf + gu * (e * pf - lam * uf)
            self.p[product] = pf + gi * (e * uf - lam * pf)

    def predict(self, user, product):
        if user in self.u and product in self.p:
            return dot(self.u[user], self.p[product]), False
        return config.COLD_START, True
