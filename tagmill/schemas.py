"""The records that the operators pass along."""

from __future__ import annotations

IMAGES = "image_id string, path string, rel_dir string, stem string, ext string, width int, height int"
LABEL_LINES = "image_id string, line_no int, line string"
BOXES = "image_id string, box_no int, cls int, cx double, cy double, w double, h double, conf double"
RAW_BOXES = "image_id string, box_no int, src_cls int, x double, y double, w double, h double, flagged boolean"
GT = "image_id string, gi int, cls int, x1 double, y1 double, x2 double, y2 double"
PRED = "image_id string, pr int, cls int, conf double, x1 double, y1 double, x2 double, y2 double"
CLASSES = "source string, cls int, name string"
CLASS_MAP = "source string, src_cls int, dst_cls int"
HASHES = "id long, h long"
FRAMES = "video_id string, frame_no long, ts_ms long"
DETECTIONS = "model string, video_id string, frame_no long, cls string, conf double, infer_ms double"
EPOCHS = "run string, epoch int, epochs int, loss double, map50 double, map double"

#: COCO files: unknown fields are ignored, missing ones are null.
COCO = (
    "images array<struct<id:long,file_name:string,filename:string,width:int,height:int>>,"
    "annotations array<struct<image_id:long,category_id:long,bbox:array<double>,iscrowd:int>>,"
    "categories array<struct<id:long,name:string>>"
)
#: VOC files, one annotation each.
VOC = (
    "filename string, size struct<width:int,height:int,depth:int>,"
    "object array<struct<name:string,difficult:int,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
)
