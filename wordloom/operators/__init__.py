"""Pipeline stages: segmentation, normalizers, splitters, model kernels, post-processors, decoders."""
