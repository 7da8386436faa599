"""Writers and manifests."""
