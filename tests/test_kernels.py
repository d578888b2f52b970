"""Gabor kernels against numbers worked out by hand."""

import numpy as np
import pytest

from stratalens.functions import kernels


def test_gabor_by_hand():
    # width 3, theta 0: x is -1, 0, 1; wavelength 0.75, deviation 0.375; sin(2 pi / 0.75) = sin(480 degrees) = sqrt(3) / 2
    side = np.exp(-1 / 0.28125) * np.sqrt(3) / 2
    corner = np.exp(-1.36 / 0.28125) * np.sqrt(3) / 2
    want = [[-corner, 0, corner], [-side, 0, side], [-corner, 0, corner]]
    assert np.allclose(kernels.gabor(3, 0.0, normed=False), want, atol=1e-12)
    assert np.allclose(kernels.gabor(3, np.pi / 2, normed=False), np.transpose(want), atol=1e-12)
    # phase of a quarter turn: the window alone in the middle
    assert kernels.gabor(3, 0.0, phi=np.pi / 2, normed=False)[1, 1] == pytest.approx(1.0)


def test_gabors_are_odd_and_of_norm_one():
    bank = kernels.gabor_bank(11, 4, 2)
    assert bank.shape == (4, 2, 11, 11)
    assert np.allclose(bank, -bank[:, :, ::-1, ::-1]) and np.allclose(bank[:, 0], -bank[:, 1])
    assert np.allclose((bank**2).sum(axis=(2, 3)), 1)


def test_scales_of_one_width():
    bank = kernels.multi_scale_bank(8 + 1, 3, 2, normed=False)
    assert bank.shape == (3, 2, 1, 9, 9)
    for s, sigma in enumerate((9 / 4 * 0.5, 9 / 4 * 1.0, 9 / 4 * 1.5)):
        # one step along x from the centre at orientation pi / 4
        along = across = np.sqrt(0.5)
        want = np.exp(-(along**2 + 0.36 * across**2) / (2 * sigma**2)) * np.sin(2 * np.pi * along / (2 * sigma))
        assert bank[s, 0, 0, 4, 5] == pytest.approx(want)
    assert kernels.multi_scale_bank(5, 2, 1, embed=11).shape == (2, 1, 1, 11, 11)
