"""Column-expression helpers: key-hash draws and numpy-compatible numerics."""

from retentia.functions.draws import (choice, digest, normal, poisson, slot, std_exponential,
                                      std_normal, uniform, uniform_int)
from retentia.functions.numeric import clip, flag, np_round, safe_div, sigmoid, stable6

__all__ = ["choice", "digest", "normal", "poisson", "slot", "std_exponential", "std_normal",
           "uniform", "uniform_int", "clip", "flag", "np_round", "safe_div", "sigmoid", "stable6"]
